"""Schemas of the files that are read and written."""

# Fixed formats: field names of analyser output, reports and advisories.
SCANNER_OUTPUT = (
    "results array<struct<test_id string, issue_text string, line_number int, issue_severity string,"
    " issue_confidence string, code string, filename string>>"
)
CODE_FINDING = (
    "type string, line int, severity string, confidence string, snippet string, description string,"
    " file string, bandit_test_id string, cwe_id string"
)
DEPENDENCY_FINDING = "package string, version string, cves array<string>, file string, severity string"
REPORT = (
    "summary struct<total_findings bigint, total_cve_findings bigint, by_severity struct<low bigint,"
    " medium bigint, high bigint, critical bigint>, scan_timestamp string>,"
    f" sast_findings array<struct<{CODE_FINDING}>>, cve_findings array<struct<{DEPENDENCY_FINDING}>>,"
    " repository_root string"
)
ADVISORY = (
    "id string, details string, aliases array<string>, affected array<struct<package struct<name string,"
    " ecosystem string>, ranges array<struct<type string, events array<map<string, string>>>>>>,"
    " `references` array<struct<type string, url string>>"
)
CORPUS_SUFFIXES = (".csv", ".md", ".yaml", ".yml")
WEAKNESS_COLUMNS = {
    "CWE-ID": "cwe_id",
    "Name": "name",
    "Description": "description",
    "Extended Description": "extended_description",
    "Potential Mitigations": "mitigations",
    "Weakness Abstraction": "weakness_abstraction",
}
DOCUMENT = (
    "source string, doc_type string, content string, pre_chunked boolean, title string, cwe_id string,"
    " vulnerability_type string, weakness_abstraction string, vulnerability_id string, aliases string,"
    " cve_ids string, h1 string, h2 string, h3 string"
)
