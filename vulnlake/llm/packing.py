"""Packing: first-fit decreasing over a tournament tree of bin capacities, in random groups.

Documents become token ids (a word BPE whose words never cross white space, so the distinct
words of a batch are encoded once), are cut at multiples of the capacity, and their pieces are
dealt at random into groups of bounded size. Each group is packed on its own: pieces from long
to short, each into the leftmost bin it fits, found by descending a tree that holds the larger
capacity of its two children in every node.

Defined cases: a null text is an empty one, whose only id is the end id; documents with equal
ids are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.bpe import PairTable, Ragged, joined, merge_words
from vulnlake.llm.common import free_name
from vulnlake.llm.pieces import slices
from vulnlake.session import stage

CAPACITY = 4096
MARKS = string.punctuation
GROUP = 8192  # pieces in a group, on average


class WordTokenizer:
    """Ids of a tokenizers file with word ends; batches are encoded by distinct words.

    Words of Latin letters, digits and marks are merged here, all at once; any other word
    (other scripts, special tokens) goes through the library.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        ways = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if ways != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or model.get("dropout"):
            raise ValueError("only lower-casing tokenizers that drop white space are supported")
        self.words = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([(vocab[x], vocab[y], r, vocab[x + y]) for r, (x, y) in enumerate(pairs)], np.int64).reshape(-1, 4)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32))
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letter[b] + end] for b in range(256)], np.int32)

    def _merged(self, names: pa.Array) -> Ragged:
        """Ids of distinct words as the word pattern gives them, in lower case."""
        sizes = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = raw_bytes(names.cast(pa.large_string()))
        symbols = self.inner[raw]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.last[raw[last]]
        return Ragged(*merge_words(self.pairs, symbols, sizes))

    def _simple(self, chunks: pa.Array) -> Ragged:
        """Chunks of letters with marks after them: one word and one run of marks each."""
        size, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (chunks, pc.ascii_rtrim(chunks, MARKS)))
        mark = np.repeat(np.tile([False, True], len(size)), np.stack([kept, size - kept], axis=1).ravel())
        raw = raw_bytes(chunks)
        both = []
        for part, n in ((raw[~mark], kept), (raw[mark], size - kept)):
            offsets = np.concatenate([[0], np.cumsum(n)])
            coded = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))).dictionary_encode()
            both.append(self._merged(coded.dictionary).take(coded.indices.to_numpy(zero_copy_only=False)))
        even = np.arange(len(size)) * 2
        return joined([even, even + 1], both).merged_by(np.full(len(size), 2))

    def _mixed(self, chunks: list[str]) -> Ragged:
        """Any Latin chunks, by the word pattern of the file."""
        found = pa.array(self.words.findall("\n".join(chunks).lower()), pa.string()) if chunks else pa.array([], pa.string())
        breaks = np.flatnonzero(pc.equal(found, "\n").to_numpy(zero_copy_only=False))
        ends = np.concatenate([breaks, [len(found)]]) if chunks else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([[-1], ends])) - 1
        coded = found.filter(pc.not_equal(found, "\n")).dictionary_encode()
        return self._merged(coded.dictionary).take(coded.indices.to_numpy(zero_copy_only=False)).merged_by(counts)

    def _foreign(self, chunks: list[str]) -> Ragged:
        rows = [np.array(e.ids, np.int32) for e in self.library.encode_batch(chunks, add_special_tokens=False)]
        return Ragged(np.concatenate([*rows, np.zeros(0, np.int32)]), np.array([len(r) for r in rows], np.int64))

    def encode_words(self, chunks: pa.Array) -> Ragged:
        """Ids of each distinct white-space free chunk of text."""
        simple = pc.match_substring_regex(chunks, r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[!-/:-@\[-`{-~]*$").to_numpy(zero_copy_only=False)
        foreign = pc.match_substring_regex(chunks, r"[^\x00-\x{24F}]|İ").to_numpy(zero_copy_only=False)
        for name in self.special:
            foreign = foreign | pc.match_substring(chunks, name).to_numpy(zero_copy_only=False)
        kinds = (simple & ~foreign, ~simple & ~foreign, foreign)
        first = pc.utf8_lower(chunks.filter(pa.array(kinds[0])))
        parts = [self._simple(first), self._mixed(chunks.filter(pa.array(kinds[1])).to_pylist()), self._foreign(chunks.filter(pa.array(kinds[2])).to_pylist())]
        return joined([np.flatnonzero(k) for k in kinds], parts)

    def encode_batch(self, texts: pa.Array) -> Ragged:
        """Ids of each text (null: none), without special tokens."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        ids = self.encode_words(coded.dictionary)
        return ids.take(coded.indices.to_numpy(zero_copy_only=False)).merged_by(np.diff(words.offsets.to_numpy()))


def raw_bytes(words: pa.LargeStringArray) -> np.ndarray:
    """The UTF-8 of all words without copying."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if len(words) and data else np.zeros(0, np.uint8)


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """The tokenizer of a file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    The checksum is over little-endian unsigned 32-bit ids; ``keep_ids`` adds them as bytes.
    """
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    shape = pa.schema([*fields, ("ids", pa.binary())] if keep_ids else fields)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            for part in slices(batch, 16_000_000):
                ids = tokenizer.encode_batch(part["text"])
                out: dict[str, list] = {n: [] for n in shape.names}
                for doc, a, n in zip(part["doc_id"].to_pylist(), ids.starts.tolist(), ids.lengths.tolist(), strict=True):
                    raw = ids.data[a : a + n].astype("<u4").tobytes() + end
                    for start in range(0, n + 1, capacity):
                        piece = raw[4 * start : 4 * (start + capacity)]
                        row = (doc, start, len(piece) // 4, zlib.crc32(piece), n + 1, piece)
                        for name, value in zip(shape.names, row, strict=False):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=shape)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces are placed from long to short, ties in their order."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(np.ceil(np.log2(max(len(lengths), 1)))))
    free = [capacity] * (2 * leaves)  # node i has the children 2i and 2i + 1
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to every piece (columns of ``token_pieces``).

    Groups are drawn from a hash of document, start and a number of the staged row, so a hot
    source, a long document and rows that repeat an id (or have none) spread over them; a group
    has about ``group`` pieces whatever the size of the table.
    """
    columns = pieces.columns
    number = free_name(pieces, "number")
    pieces = stage(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        # Rows of equal document and start are told apart by their content only; which of
        # two equal rows comes first changes nothing.
        frame = frame.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame["group_"].to_numpy().astype(np.int64) << 32) + bins
        frame["offset"] = offsets
        return frame[[*columns, "sequence_id", "offset"]]

    key = F.pmod(F.xxhash64("doc_id", "start", number, F.lit(5)), F.lit(groups)).cast("long")
    pieces = pieces.withColumn("group_", key).drop(number)
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c != "group_") + ", sequence_id long, offset long"
    return pieces.groupBy("group_").applyInPandas(place, schema)
