"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Base kinds (fixed values): ``assign``, ``access`` and ``hex``, each found leftmost and
non-overlapping by its pattern; a match that is too short is dropped after it has matched.

The kind ``random`` adds tokens that look drawn at random from an alphabet. The encoding (hex,
base32, base62, base64) is inferred from the characters present. Three tests compare a token
with both hypotheses: uniform draws from its alphabet, and ordinary text, whose letter shares
and class changes are measured over all letters and digits of the corpus (the few keys among
them weigh next to nothing).

* chi-squared of the symbol counts against a uniform alphabet;
* runs: changes between letters of either case, digits and marks;
* serial correlation of neighbouring symbols.

A token is a candidate if uniform draws explain it in all tests. Its p-value is the chance
that ordinary text looks as uniform, in chi-squared and in runs (the larger of the two). Tokens are
ranked within classes of inferred encoding and length, so that words and slugs do not stand in
the way of keys, and the Benjamini-Hochberg step-up rule with a share of false discoveries
``rate`` is applied per class, counting all tested tokens of that class. Only a histogram of
p-values per class (bounded size) comes to the driver.

Defined cases: a null text is an empty one; an empty text has no spans; spans are in code
points, end exclusive; a random token that overlaps a base span is left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.session import stage

# The base patterns, the shortest length of each, and the order of the kinds.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_KEY = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so its length decides
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

ALPHABETS = {"hex": 16, "base32": 32, "base62": 62, "base64": 64}
RATE = 0.05
LIKELY = 1e-3  # uniform draws fall below this in one test of a thousand
CLASSES = (24, 32, 48, 64, 128)  # upper ends of the length classes
BINS = 64  # the largest -log10 p that is told apart
FINE = 100  # bins of a unit of -log10 p

SPAN = "array<struct<kind:int,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    out = []
    if ("=" in text or ":" in text) and _ASSIGN_KEY.search(text):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def encoding(token: str) -> str:
    """The smallest alphabet that explains the characters of a token."""
    body = token.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+|[a-z2-7]+", body):
        return "base32"
    return "base62" if body.isalnum() else "base64"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(maxsize=4096)
def _chi_square_center(n: int, size: int) -> tuple[float, float]:
    """Mean and standard deviation of the chi-squared sum of n uniform draws (exact moments)."""
    return size - 1.0, math.sqrt(max(2.0 * (size - 1) * (n - 1) / n, 1e-9))


def battery(token: str) -> tuple[float, float, float, float, float]:
    """Chi-squared, its z under uniform draws, class changes, their z, and serial correlation's z."""
    body = token.rstrip("=")
    size = ALPHABETS[encoding(token)]
    n = len(body)
    codes = np.frombuffer(body.encode(), np.uint8)
    counts = np.bincount(codes, minlength=128)
    chi = float((counts.astype(np.float64) ** 2).sum() * size / n - n)
    mean, sd = _chi_square_center(n, size)
    classes = _CLASS[codes]
    shares = np.bincount(classes, minlength=4) / n
    changes = int((classes[1:] != classes[:-1]).sum())
    stay = float((shares**2).sum())
    expected = (n - 1) * (1 - stay)
    spread = math.sqrt(max((n - 1) * stay * (1 - stay), 1e-9))
    runs_z = (changes - expected) / spread if stay < 1 else 0.0
    x = codes.astype(np.float64) - codes.mean()
    power = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / power if power else 1.0
    serial_z = (serial + 1 / n) * math.sqrt(n)
    return chi, (chi - mean) / sd, float(changes), runs_z, serial_z


_CLASS = np.full(128, 3)
for _c in range(128):
    _CLASS[_c] = 0 if chr(_c).islower() else 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3


def plain_p(token: str, text_share: float, text_change: float) -> float:
    """Chance that ordinary text of this length looks as uniform as the token; 1 if uniform draws do not explain it.

    ``text_share``: sum of squared character shares of ordinary words; ``text_change``: how
    often neighbouring characters differ in class there.
    """
    chi, chi_z, changes, runs_z, serial_z = battery(token)
    if min(_normal_tail(max(chi_z, 0.0)), _normal_tail(runs_z), _normal_tail(serial_z)) < LIKELY:
        return 1.0
    n, size = len(token.rstrip("=")), ALPHABETS[encoding(token)]
    # non-central chi-squared of ordinary text, by its first two moments
    away = n * max(text_share * size - 1, 0.1)
    mean, sd = size - 1 + away, math.sqrt(2 * (size - 1 + 2 * away))
    p_chi = 0.5 * math.erfc((mean - chi) / sd / math.sqrt(2))
    # class changes of ordinary text: binomial, by its normal tail with continuity correction
    mean, sd = (n - 1) * text_change, math.sqrt((n - 1) * text_change * (1 - text_change))
    p_runs = 0.5 * math.erfc((changes - 0.5 - mean) / sd / math.sqrt(2))
    return max(p_chi, p_runs)


def length_class(n: int) -> int:
    return next((i for i, end in enumerate(CLASSES) if n <= end), len(CLASSES))


def token_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of long unbroken tokens that meet no base span."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    # both by start; base spans of several kinds may overlap, so the furthest end so far counts
    spans, at, covered, out = sorted((a, b) for _, a, b in base), 0, 0, []
    for m in _TOKEN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][1])
            at += 1
        if covered <= m.start():
            out.append((m.start(), m.end(), m.group()))
    return out


_ALNUM = np.array([*range(48, 58), *range(65, 91), *range(97, 123)])


def _text_counts(texts: list[str]) -> list[int]:
    """Counts of ASCII digits and letters, class changes between them and neighbour pairs."""
    counts, changes, pairs = np.zeros(128, np.int64), 0, 0
    for text in texts:
        codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        counts += np.bincount(codes, minlength=128)[:128]
        classes = _CLASS[codes]
        both = (classes[1:] < 3) & (classes[:-1] < 3)
        changes += int(((classes[1:] != classes[:-1]) & both).sum())
        pairs += int(both.sum())
    return [*counts[_ALNUM].tolist(), changes, pairs]


def found_column(text: Column) -> Column:
    """Struct of base spans, long tokens, and text counts (those of a batch, in its first row)."""

    @F.pandas_udf(f"base {SPAN}, tokens array<struct<start:int,end:int,token:string>>, counts array<long>")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = texts.tolist()
        base = [base_spans(t) for t in rows]
        tokens = [token_spans(t, b) for t, b in zip(rows, base, strict=True)]
        counts = [_text_counts(rows), *[None] * (len(rows) - 1)] if rows else []
        return pd.DataFrame({"base": base, "tokens": tokens, "counts": counts})

    return find(F.coalesce(text.cast("string"), F.lit("")))


@dataclass(frozen=True)
class SecretModel:
    """Shares of ordinary text, and per encoding and length class the smallest bin that counts as found."""

    share: float
    change: float
    cuts: dict[tuple[str, int], float]

    def discoveries(self, tokens: list) -> list[tuple[int, int, int]]:
        out = []
        for start, end, token in tokens:
            kind, size, bin_ = _rank(token, self.share, self.change)
            cut = self.cuts.get((kind, size))
            if cut is not None and bin_ / FINE >= cut:
                out.append((KINDS.index("random"), start, end))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans of a text, by start, then kind."""
        base = base_spans(text)
        return sorted(base + self.discoveries(token_spans(text, base)), key=lambda s: (s[1], s[0]))


def learn(found: DataFrame, rate: float = RATE) -> SecretModel:
    """Model from a staged table with the struct of ``found_column`` spread to columns."""
    totals = found.select(*[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(64)]).first()
    n = np.array([totals[i] or 0 for i in range(64)], float)
    share = float((n[:62] ** 2).sum() / max(n[:62].sum(), 1) ** 2) or 0.06
    change = min(max(n[62] / max(n[63], 1), 0.02), 0.3)

    @F.pandas_udf("array<struct<encoding:string,class:int,bin:int>>")
    def ranked(tokens: pd.Series) -> pd.Series:
        return pd.Series([[_rank(x["token"], share, change) for x in row] for row in tokens])

    each = found.where(F.size("tokens") > 0).select(F.explode(ranked("tokens")).alias("t")).groupBy("t.encoding", "t.class", "t.bin").count()
    histogram: dict[tuple[str, int], dict[float, int]] = {}
    for r in each.collect():
        histogram.setdefault((r["encoding"], r["class"]), {})[r["bin"] / FINE] = r["count"]
    cuts = {c: step_up(bins, rate) for c, bins in histogram.items()}
    return SecretModel(share, change, {c: b for c, b in cuts.items() if b is not None})


def _rank(token: str, share: float, change: float) -> tuple[str, int, int]:
    """Encoding, length class and bin (in parts of 1 / FINE, rounded down) of a token."""
    p = plain_p(token, share, change)
    return encoding(token), length_class(len(token)), min(int(-math.log10(max(p, 1e-300)) * FINE), BINS * FINE)


def step_up(bins: dict[float, int], rate: float) -> float | None:
    """Smallest bin b such that all p-values of at most 10**-b may be called discoveries (None: none).

    Benjamini-Hochberg on the histogram, each bin taken at its upper end.
    """
    total, held, best = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if b > 0 and 10.0**-b * total <= rate * held:
            best = b
    return best


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base spans and all spans of every document."""
    found = stage(docs.select("doc_id", found_column(F.col("text")).alias("f")).select("doc_id", "f.*"), "secrets")
    model = learn(found, rate)

    @F.pandas_udf(SPAN)
    def more(tokens: pd.Series) -> pd.Series:
        return pd.Series([model.discoveries([(x["start"], x["end"], x["token"]) for x in row]) for row in tokens])

    extra = F.when(F.size("tokens") > 0, more("tokens")).otherwise(F.array().cast(SPAN))
    return found.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", extra)).alias("spans"))


def _ordered(spans: Column) -> Column:
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def count_of(spans: str, kind: int) -> Column:
    """Number of spans of a kind (a number of ``KINDS``)."""
    # the function has one parameter only: Spark would give a second one the place in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """Documents with every span replaced by ``mark`` (``n_chars`` follows, where there is one)."""
    found = stage(docs.select(found_column(F.col("text")).alias("f")).select("f.tokens", "f.counts"), "secret-tokens")
    model = learn(found, rate)

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _without(t, model.spans(t), mark) for t in texts], dtype=object)

    out = docs.withColumn("text", replace.asNondeterministic()("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
