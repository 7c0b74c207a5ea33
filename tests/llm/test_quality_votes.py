"""Quality rules: counts against a plain restatement, EM against one by hand, verdicts on made-up texts."""

import random
from collections import Counter

import pytest

from helpers import DOCS, odd_rows, prose
from vulnlake.llm import quality_votes as q

SPACE = " \t\n\x0b\x0c\r"


def plain_counts(text):
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
        "n_capitals": sum(c.isupper() for c in text),
        "n_letters": sum(c.isalpha() for c in text),
        "n_loud": text.count("!"),
        "n_stop": len(set(words) & set(q.STOP_WORDS)),
    }


def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.choice(["en", "de"]), rng.randint(1, 200)) for _ in range(150)]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    out += ["\n".join([prose(rng, "en", 6)] * 3 + ["", "  ", "\r"]) for _ in range(20)]
    out += ["a\x0bb\x0cc\rd\te  f", "#*$%&|<> ###", "a b c d e a b c d e", "x x x x x x", "x x x x x", "ÄÖÜ äöü 漢字 😀", "   wide spaces"]
    out += [prose(rng, "en", 80).upper().replace(" ", "!! ") for _ in range(15)] + [" ".join(w + "$$$ ###" for w in prose(rng, "en", 70).split()) for _ in range(15)]
    return out


def test_counts_equal_a_plain_restatement(spark):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts())] + odd_rows()
    got = q.counted(spark.createDataFrame(rows, DOCS)).collect()
    want = [(r[0], *plain_counts(r[1]).values()) for r in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_em_equals_a_restatement_by_hand(spark):
    rng = random.Random(8)
    rules = len(q.RULES)
    votes = Counter()
    for _ in range(3000):
        good = rng.random() < 0.8
        votes[tuple(0 if rng.random() < 0.3 else (1 if good else -1) * (1 if rng.random() < 0.6 + 0.03 * j else -1) for j in range(rules))] += 1
    table = spark.createDataFrame([(*v, n) for v, n in votes.items()], ", ".join(f"v{j} int" for j in range(rules)) + ", n long")
    model = q.learn(table, rounds=6)
    pi, good, bad = q.START, [q.START] * rules, [q.START] * rules
    for _ in range(6):
        p = {}
        for v in votes:
            a, b = pi, 1 - pi
            for j, x in enumerate(v):
                a *= {1: good[j], -1: 1 - good[j], 0: 1}[x]
                b *= {1: 1 - bad[j], -1: bad[j], 0: 1}[x]
            p[v] = a / (a + b)
        rate = lambda right, voted: min(q.MOST, max(q.LEAST, (right + q.START * q.PRIOR) / (voted + q.PRIOR)))
        pi = rate(sum(n * p[v] for v, n in votes.items()), sum(votes.values()))
        good = [rate(sum(n * p[v] for v, n in votes.items() if v[j] == 1), sum(n * p[v] for v, n in votes.items() if v[j])) for j in range(rules)]
        bad = [rate(sum(n * (1 - p[v]) for v, n in votes.items() if v[j] == -1), sum(n * (1 - p[v]) for v, n in votes.items() if v[j])) for j in range(rules)]
    assert model.prior == pytest.approx(pi) and model.good == pytest.approx(good) and model.bad == pytest.approx(bad)
    assert 0.75 < model.prior < 0.85 and model.good[-1] > model.good[0]


def test_verdicts(spark):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts())] + odd_rows()
    got = {r.doc_id: r for r in q.judged(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id is not None}
    n = len(texts())
    assert not any(got[i].kept for i in range(n - 30, n))
    clean = [got[i] for i in range(150) if got[i].n_words >= 50 and not got[i].base_failed]
    assert clean and all(r.kept for r in clean)
    assert not any(got[i].kept for i in (9001, 9002, 9003, 9004)) and all(0 <= r.quality <= 1 for r in got.values())
    assert q.judged(spark.createDataFrame([], DOCS)).count() == 0


def test_main_path_is_native(spark):
    plan = q.judged(spark.createDataFrame([(1, "a b", None, None, None, None, None)], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
