"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). No rule
decides alone. How far each can be trusted is not set by hand: expectation-maximisation over the
votes of all documents estimates the share of good documents, and for each rule how often it is
right about good and about bad documents when it votes. A document's posterior probability of
being good follows from these (votes taken as independent given the quality), and it is kept
from ``KEEP`` on, unless a base rule fails.

* All counts are native expressions on the row; repeated windows are found by sorting the
  windows of one text, only where there are any. No text is shuffled.
* EM needs the votes only: documents are counted by vote pattern (3 ** len(RULES) patterns at
  most, whatever the corpus), and each round is one aggregate over that table.
* Rules are held better than chance (rates between ``LEAST`` and ``MOST``), which keeps EM from
  exchanging good and bad; each rate starts with ``PRIOR`` pseudo-votes.

Defined cases: a null text has no words; empty and blank texts have no words and fail the base
rules; the counts of a row depend on its own text only, and rows that repeat an id are judged
each; without documents there is nothing to learn and nothing to return.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.session import stage

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
ROUNDS, KEEP = 20, 0.5
START, PRIOR = 0.8, 5.0  # the rates before the first round, and pseudo-votes that hold them
LEAST, MOST = 0.55, 0.995

# Frequent function words of the languages in view.
STOP_WORDS = (
    "the of and to in is that for was with as on be by "
    "der die und den das von zu mit ist ein eine "
    "le la les et des un une dans que pour qui est "
    "el los de en las por con una su para del se"
).split()

#: name: (votes bad where, votes good where); whole-number comparisons of the counts
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 10 * n_words", "word_chars >= 4 * n_words AND word_chars <= 8 * n_words AND n_words > 0"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    "lines": ("n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    "repetition": ("10 * n_repeat_words > n_words", "n_words >= 50 AND 50 * n_repeat_words <= n_words"),
    "variety": ("n_words >= 50 AND n_words <= 1000 AND 5 * n_distinct < n_words", "n_words >= 50 AND n_words <= 1000 AND 5 * n_distinct > 2 * n_words"),
    "capitals": ("n_letters >= 20 AND 5 * n_capitals > 2 * n_letters", "n_letters >= 20 AND 10 * n_capitals <= n_letters"),
    "loudness": ("20 * n_loud > n_words", "100 * n_loud <= n_words AND n_words >= 20"),
    "function_words": ("n_words >= 30 AND n_stop = 0", "n_stop >= 3"),
    "letters": ("10 * n_letters < 6 * word_chars", "10 * n_letters >= 8 * word_chars AND n_words > 0"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_letters", "n_loud", "n_stop")


def vote_sql(rule: str) -> str:
    bad, good = RULES[rule]
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Number of words inside windows that a text holds twice or more (the first included).

    ``windows``: the text's windows in order; window i covers words i to i + width - 1.
    """
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    # a lambda binds the sorted array, so that it is made once and not for each element
    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), F.get(s, k + 1)["w"] == x["w"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + width - F.greatest(a["end"], i)).alias("n"), (i + width).alias("end"))
        return F.aggregate(at, first, step, lambda a: a["n"])

    return F.transform(F.transform(F.array(placed), starts), covered)[0]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select("doc_id", "text", F.array_remove(F.split("text", SPACES + "+"), "").alias("words"))
    count = F.size("words")
    at = F.when(count >= WINDOW, F.sequence(F.lit(0), count - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = F.transform(at, lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(WINDOW)]))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.rtrim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "")
    split = split.select("*", window.alias("windows"), lines.alias("lines"))

    def without(characters: str) -> Column:
        return F.length("text") - F.length(F.translate("text", characters, ""))

    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", f"[^{pattern}]+", ""))

    values = {
        "n_words": count,
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("windows") > F.size(F.array_distinct("windows")), repeated_words(F.col("windows"))).otherwise(0),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_capitals": only(r"\p{Lu}"),
        "n_letters": only(r"\p{L}"),
        "n_loud": without("!"),
        "n_stop": F.size(F.array_intersect("words", F.split(F.lit(" ".join(STOP_WORDS)), " "))),
    }
    return split.select("doc_id", *[values[c].cast("long").alias(c) for c in COUNTS])


def log_odds_sql(prior: str, good: list[str], bad: list[str], votes: list[str]) -> str:
    """Log-odds of good quality; good/bad: how often each rule is right about good and bad documents."""
    terms = [
        f"(CASE {v} WHEN 1 THEN ln({g} / (1 - {b})) WHEN -1 THEN ln((1 - {g}) / {b}) ELSE 0e0 END)" for g, b, v in zip(good, bad, votes, strict=True)
    ]
    return " + ".join([f"ln({prior} / (1 - {prior}))", *terms])


def rate_sql(right: str, voted: str) -> str:
    """A rate from the summed posteriors of right votes and of votes, with its pseudo-votes."""
    return f"least({MOST}e0, greatest({LEAST}e0, ({right} + {START * PRIOR}e0) / ({voted} + {PRIOR}e0)))"


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and each rule's rates (in the order of RULES)."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self) -> Column:
        """Probability of good quality, from the vote columns v0, v1, ...

        What a vote adds to the log-odds is looked up by the vote, in constant arrays: a new model
        is new data for the same compiled code.
        """
        odds = None
        for j, (g, b) in enumerate(zip(self.good, self.bad, strict=True)):
            adds = [math.log((1 - g) / b), 0.0, math.log(g / (1 - b))]
            if j == 0:
                adds = [x + math.log(self.prior / (1 - self.prior)) for x in adds]
            part = F.element_at(F.array(*map(F.lit, adds)), F.col(f"v{j}") + 2)
            odds = part if odds is None else odds + part
        return 1 / (1 + F.exp(-odds))


def learn(patterns: DataFrame, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over the vote patterns v0, v1, ... with their number ``n``."""
    model = VoteModel(START, (START,) * len(RULES), (START,) * len(RULES))
    p, n = F.col("p"), F.col("n")
    for _ in range(rounds):
        sums = [F.sum(n * p), F.sum(n)]
        for j in range(len(RULES)):
            v = F.col(f"v{j}")
            sums += [F.sum(F.when(v == 1, n * p)), F.sum(F.when(v != 0, n * p)), F.sum(F.when(v == -1, n * (1 - p))), F.sum(F.when(v != 0, n * (1 - p)))]
        seen = patterns.withColumn("p", model.posterior()).agg(*[F.coalesce(s, F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums)]).first()

        def rate(right: float, voted: float) -> float:
            return min(MOST, max(LEAST, (right + START * PRIOR) / (voted + PRIOR)))

        good = tuple(rate(seen[2 + 4 * j], seen[3 + 4 * j]) for j in range(len(RULES)))
        bad = tuple(rate(seen[4 + 4 * j], seen[5 + 4 * j]) for j in range(len(RULES)))
        model = VoteModel(rate(seen[0], seen[1]), good, bad)
    return model


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept of every document."""
    counts = stage(counted(docs), "quality-counts")
    voted = counts.select("*", *[F.expr(vote_sql(rule)).alias(f"v{j}") for j, rule in enumerate(RULES)])
    votes = [f"v{j}" for j in range(len(RULES))]
    model = learn(stage(voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")), "vote-patterns"))
    out = voted.select("doc_id", *COUNTS, F.expr(BASE_FAILED).alias("base_failed"), model.posterior().alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
