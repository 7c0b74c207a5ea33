"""Text column functions: whitespace, tokens, decoding, requirement specs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values ------------------------------------------------------------
# Unicode whitespace as a regex class and as a character list for trimming.
WHITESPACE = r"(?U:[\s\x1c\x1d\x1e\x1f])"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Encodings tried on a manifest, in this order.
ENCODINGS = ("utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "latin-1")
# -----------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def lstrip(text: Column) -> Column:
    """Remove leading whitespace of any kind."""
    return F.ltrim(text, F.lit(WHITESPACE_CHARS))


def indent_of(line: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(line) - F.length(lstrip(line))


def lines_of(text: Column) -> Column:
    """Lines split at ``\\n`` (a trailing newline yields a last empty line)."""
    return F.split(text, "\n", -1)


def any_lines_of(text: Column) -> Column:
    """Lines split at every kind of line break."""
    return F.split(text, LINE_BREAK, -1)


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens; no empty ones."""
    bare = strip(F.lower(text))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, f"{WHITESPACE}+"))


def unescape_newlines(text: Column) -> Column:
    """P10: the two characters ``\\n`` become a newline."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def clean_snippet(code: Column) -> Column:
    """Drop a leading line number on every line, trim the whole; empty -> null.

    Line by line, since in one multi-line regex the blanks after the number could
    swallow the following newline.
    """
    cleaned = F.transform(
        lines_of(code), lambda line: F.regexp_replace(line, rf"^\d+{WHITESPACE}*", "")
    )
    return F.when(F.length(code) > 0, strip(F.array_join(cleaned, "\n")))


def title_case(text: Column) -> Column:
    """Every run of letters starts upper-case and goes on lower-case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def guide_title(path: Column) -> Column:
    """File stem as a title."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return title_case(F.replace(stem, F.lit("_"), F.lit(" ")))


def cve_aliases(aliases: Column) -> Column:
    """Comma-joined aliases that are CVE ids."""
    return F.array_join(F.filter(aliases, lambda a: a.startswith("CVE-")), ", ")


def suffix_of(path: Column) -> Column:
    """Lower-cased file suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


@F.pandas_udf(T.StringType())
def _decode_other(raw: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8 to text, with the first other encoding that fits."""

    def decode(blob: bytes | None) -> str | None:
        if blob is None:
            return None
        for name in ENCODINGS[1:]:
            try:
                return bytes(blob).decode(name)
            except UnicodeError:
                continue
        return None

    return raw.map(decode)


def decode_text(raw: Column | str) -> Column:
    """Bytes to text with the first encoding that fits (see ENCODINGS).

    UTF-8 is told and read natively; only other bytes pass through Python.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = raw.cast("string")
    utf8 = F.is_valid_utf8(text)
    return F.when(utf8, F.regexp_replace(text, "^\ufeff", "")).otherwise(_decode_other(F.when(~utf8, raw)))


# Requirement specs (P8/P9): name, optional extras, specifier list, optional marker.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_VERSION = r"[^\s,;()<>=!~]+"
_OPERATOR = r"===|~=|==|!=|<=|>=|<|>"
_CLAUSE = rf"(?:{_OPERATOR})\s*{_VERSION}"
_SPEC = (
    rf"^\s*({_NAME})\s*(?:\[[^\]]*\])?\s*\(?\s*"
    rf"({_CLAUSE}(?:\s*,\s*{_CLAUSE})*\s*,?)?\s*\)?\s*(?:;.*)?$"
)


def parse_requirement(spec: Column) -> Column:
    """``struct(name, specs array<struct<op, version>>)``; null without specifier.

    Extras and environment markers are read over. Text that is not a requirement,
    and a bare name, both give null: there is no version to look up.
    """
    name = F.regexp_extract(spec, _SPEC, 1)
    clauses = F.regexp_extract(spec, _SPEC, 2)
    found = F.regexp_extract_all(clauses, F.lit(rf"({_CLAUSE})"), F.lit(1))
    specs = F.transform(
        found,
        lambda c: F.struct(
            F.regexp_extract(c, rf"^({_OPERATOR})", 1).alias("op"),
            F.regexp_replace(c, rf"^(?:{_OPERATOR})\s*", "").alias("version"),
        ),
    )
    return F.when(clauses != "", F.struct(name.alias("name"), specs.alias("specs")))


def pick_version(specs: Column) -> Column:
    """The exact version, else a lower bound, else an upper bound, else null."""

    def first(*ops: str) -> Column:
        return F.get(F.filter(specs, lambda s: s["op"].isin(*ops)), F.lit(0))["version"]

    return F.coalesce(first("=="), first(">=", ">"), first("<", "<="))
