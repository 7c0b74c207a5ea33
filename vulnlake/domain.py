"""Shared dimensions: severities, confidences, finding categories, rule map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: enumerations and defaults that results depend on ---------
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
REMEDIATION_CONFIDENCES = ["High", "Medium", "Low"]

UNKNOWN_CATEGORY = "Unknown Vulnerability"

# Analyser rule id -> finding category.
RULE_CATEGORIES = {
    "B101": "Dangerous Code Execution",
    "B102": "Dangerous Code Execution",
    "B103": "Dangerous Code Execution",
    "B104": "Hardcoded Secret",
    "B105": "Hardcoded Secret",
    "B106": "Hardcoded Secret",
    "B107": "Hardcoded Secret",
    "B108": "Insecure Temp File Access",
    "B110": "Dangerous Code Execution",
    "B112": "Dangerous Code Execution",
    "B113": "Insecure Configuration",
    "B201": "Insecure Configuration",
    "B202": "Path Traversal",
    "B301": "Insecure Deserialization",
    "B302": "Insecure Deserialization",
    "B313": "XML Vulnerability",
    "B314": "XML Vulnerability",
    "B315": "XML Vulnerability",
    "B316": "XML Vulnerability",
    "B317": "XML Vulnerability",
    "B318": "XML Vulnerability",
    "B319": "XML Vulnerability",
    "B320": "XML Vulnerability",
    "B324": "Weak Cryptography",
    "B501": "Weak Cryptography",
    "B502": "Weak Cryptography",
    "B503": "Weak Cryptography",
    "B504": "Weak Cryptography",
    "B505": "Weak Cryptography",
    "B506": "Insecure Deserialization",
    "B507": "Weak Cryptography",
    "B508": "Weak Cryptography",
    "B509": "Weak Cryptography",
    "B601": "Insecure Configuration",
    "B602": "Command Injection",
    "B603": "Command Injection",
    "B604": "Command Injection",
    "B605": "Command Injection",
    "B606": "Command Injection",
    "B607": "Command Injection",
    "B608": "SQL Injection",
    "B609": "Command Injection",
    "B610": "SQL Injection",
    "B611": "SQL Injection",
    "B612": "Insecure Configuration",
    "B613": "Dangerous Code Execution",
    "B614": "Insecure Deserialization",
    "B615": "Insecure Deserialization",
    "B701": "Cross-Site Scripting",
    "B702": "Cross-Site Scripting",
    "B703": "Cross-Site Scripting",
    "B704": "Cross-Site Scripting",
}

# Chunking and retrieval defaults.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
VECTOR_K = 4
VECTOR_FETCH_K = 12
BM25_TOP_K = 2
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
MMR_LAMBDA = 0.5
MIN_DOCS_BEFORE_BM25 = 4
RERANK_TOP_K = 2
RERANK_BATCH = 8
CACHE_THRESHOLD = 0.85
CACHE_SIZE = 100

# Patching defaults.
SEARCH_RADIUS = 10
FUZZY_THRESHOLD = 0.85
# ---------------------------------------------------------------------------


def finding_types() -> list[str]:
    """The twelve categories, the unknown one last."""
    return sorted(set(RULE_CATEGORIES.values())) + [UNKNOWN_CATEGORY]


def rules_frame(spark: SparkSession) -> DataFrame:
    """Dimension ``(test_id, category)``; its size is fixed by RULE_CATEGORIES."""
    return spark.createDataFrame(
        list(RULE_CATEGORIES.items()), "test_id string, category string"
    )


def rank_of(label: Column, ranks: dict[str, int], default: int | None = None) -> Column:
    """Rank of a label, case-insensitive; unknown labels get ``default``."""
    expr = None
    for name, rank in ranks.items():
        hit = F.lower(label) == name
        expr = F.when(hit, rank) if expr is None else expr.when(hit, rank)
    return expr.otherwise(F.lit(default).cast("int"))


def severity_rank(label: Column, default: int | None = None) -> Column:
    return rank_of(label, SEVERITY_RANK, default)
