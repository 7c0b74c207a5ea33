"""Small tables with odd rows, and plain reference versions."""

from __future__ import annotations

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, number string, rep int"
WORDS = {
    "en": "the of and that with which there these other their would about from have been".split(),
    "de": "der die und nicht mit auch eine werden über für größer schön während können müssen".split(),
}


def prose(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    out = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, repeated, very long and id-less rows, with columns of clashing names."""
    long = prose(random.Random(5), words=30_000)
    texts = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one two"), (9005, "one two"), (9005, "one two"), (9006, "123 456"), (9007, long), (None, "no id here"), (None, None)]
    return [(i, t, None, None, None, "x", 1) for i, t in texts]


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def shingle_set(text: str | None, size: int = 4) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(n: int) -> int:
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
