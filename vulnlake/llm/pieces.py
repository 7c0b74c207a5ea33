"""SentencePiece (BPE) encoding and decoding with source alignment.

* Normalisation walks the source with the longest prefix the compiled character map knows
  (a double-array trie followed by its replacement strings) and records, for every byte it
  writes, the source byte it stems from.
* The normalised text is cut where no vocabulary piece could span the cut; the distinct units
  of a batch are merged together (best score first, leftmost first).
* Pieces are projected to source bytes through the alignment.

Defined cases: a null text is an empty one; an empty text has only the begin and end ids and
no spans. Characters without a piece fall back to byte ids, or to the unknown id where the
model has none. Vocabularies whose normaliser strips extra spaces or puts spaces at word ends
are refused, as is any model type but BPE.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.bpe import PairTable, Ragged, joined, merge_words, spread

SPACE = "▁"
_SPACE = SPACE.encode()
SEPARATOR = "\x01"
FOREIGN = 1 << 22


class CharacterMap:
    """Longest-prefix replacement through a compiled map: trie size, double array, strings."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | list[int] = []
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(source length, replacement) of the longest known prefix of raw[at:]."""
        units, found = self.units, None
        if not units:
            return None
        root = units[0]
        node = (root >> 10) << ((root & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


@dataclass
class PieceModel:
    """Vocabulary, merges and normaliser of one model file."""

    ids: dict[str, int]
    scores: dict[str, float]
    pieces: list[str]
    byte_ids: list[int] | None
    unknown: int
    begin: int
    end: int
    dummy_prefix: bool
    characters: CharacterMap
    joined: set[str] = field(default_factory=set)
    merging_breaks: bool = False
    lengths: list[int] = field(default_factory=list)
    surfaces: list[bytes] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, blob: bytes) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != pb.TrainerSpec.BPE or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that keep spaces, as prefixes, are supported")
        kind = pb.ModelProto.SentencePiece
        pieces = [p.piece for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)]
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE]
        out = cls(
            ids={pieces[i]: i for i in normal},
            scores={pieces[i]: proto.pieces[i].score for i in normal},
            pieces=pieces,
            byte_ids=byte_ids if trainer.byte_fallback else None,
            unknown=trainer.unk_id,
            begin=trainer.bos_id,
            end=trainer.eos_id,
            dummy_prefix=norm.add_dummy_prefix,
            characters=CharacterMap(norm.precompiled_charsmap),
        )
        out.lengths = [len(p.encode()) for p in pieces]
        out.surfaces = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in (out.begin, out.end, *(i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL)):
            out.surfaces[i] = b""
        for b, i in enumerate(byte_ids):
            out.surfaces[i] = bytes([b])
        out.surfaces[out.unknown] = trainer.unk_surface.encode()
        for p in out.ids:
            out.joined.update(a + b for a, b in zip(p, p[1:], strict=False))
        letters = {c for pair in out.joined for c in pair} - {SPACE}
        out.merging_breaks = "\n" in letters
        inside = "".join(re.escape(c) for c in sorted(letters))
        if any(SPACE in p.lstrip(SPACE) for p in out.ids):
            raise ValueError("pieces with inner spaces are not supported")
        # A unit is spaces and what may merge with them; any other character stands alone.
        out.units = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}]" if inside else ".", re.DOTALL)
        return out

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, per byte of it and one past, the source byte it starts from."""
        raw = text.encode("utf-8")
        out, align, at = bytearray(), [], 0
        if self.dummy_prefix and raw:
            out += _SPACE
            align += [0] * len(_SPACE)
        if not self.characters.units:  # nothing is replaced but the space
            body = raw.replace(b" ", _SPACE)
            source = np.frombuffer(raw, np.uint8)
            starts = np.repeat(np.arange(len(source)), np.where(source == 32, len(_SPACE), 1))
            return (bytes(out) + body).decode(), np.concatenate([align, starts, [len(raw)]]).astype(np.int64)
        while at < len(raw):
            hit = self.characters.longest(raw, at)
            if hit:
                width, new = hit
            else:
                lead = raw[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at : at + width]
            new = new.replace(b" ", _SPACE)
            out += new
            align += [at] * len(new)
            at += width
        return bytes(out).decode(), np.array([*align, len(raw)], np.int64)

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE: joins the adjacent pair with the best score, leftmost first, until none is known."""
        if len(symbols) > 48:
            return self._merge_long(symbols)
        get, none = self.scores.get, -math.inf
        pairs = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = get(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over linked symbols, for units without a break."""
        from heapq import heapify, heappop, heappush

        n, scores = len(symbols), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, symbols[i] + symbols[i + 1]))
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, joined = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], alive[j], after[i] = joined, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    s = scores.get(symbols[a] + symbols[b])
                    if s is not None:
                        heappush(heap, (-s, a, symbols[a] + symbols[b]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def unit_ids(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a unit and the normalised bytes each covers (byte ids cover one)."""
        get, ids, sizes = self.ids.get, [], []
        for piece in self.merge(list(unit)):
            i = get(piece)
            if i is not None:
                ids.append(i)
                sizes.append(self.lengths[i])
            elif self.byte_ids:
                raw = piece.encode()
                ids += [self.byte_ids[b] for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(piece.encode()))
        return ids, sizes

    def encode(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, start byte, end byte in the source) of every piece, with begin and end ids.

        Where several pieces share one source character (byte ids, or a replacement that was
        split), inner borders fall on that character's start or end.
        """
        norm, align = self.normalise(text or "")
        out, at = [(self.begin, 0, 0)], 0
        for unit in self.units.findall(norm):
            for i, size in zip(*self.unit_ids(unit), strict=True):
                out.append((i, int(align[at]), int(align[at + size])))
                at += size
        return [*out, (self.end, int(align[-1]), int(align[-1]))]

    def surface(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces with spaces restored; byte ids give their bytes."""
        return b"".join([self.surfaces[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the dummy space goes; bytes that form no character become U+FFFD."""
        out = self.surface(ids)
        first = next((i for i in ids if i not in (self.begin, self.end)), None)
        if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE):
            out = out[1:]
        return _whole(out).decode("utf-8")

    def tables(self) -> None:
        """Arrays for whole batches, made once per worker: characters, merges, surfaces."""
        if hasattr(self, "pairs"):
            return
        names = list(self.ids)
        known = {**self.ids}
        for c in {c for p in names for c in p}:
            known.setdefault(c, len(self.pieces) + len(known))
        order = {v: r for r, v in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = [
            (known[p[:i]], known[p[i:]], order[self.scores[p]], self.ids[p])
            for p in names
            for i in range(1, len(p))
            if p[:i] in known and p[i:] in known
        ]
        a = np.array(rows, np.int64).reshape(-1, 4)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32))
        # a character without a symbol is FOREIGN + its code point and never merges
        self.of_character = np.arange(0x110000, dtype=np.int32) + FOREIGN
        for p, i in known.items():
            if len(p) == 1:
                self.of_character[ord(p)] = i
        self.of_character[32] = self.of_character[ord(SPACE)]
        self.covers = np.array(self.lengths, np.int64)  # normalised bytes of a piece
        if self.byte_ids:
            self.covers[self.byte_ids] = 1
        self.shown = Ragged(np.frombuffer(b"".join(self.surfaces), np.uint8), np.array([len(x) for x in self.surfaces]))

    def encode_words(self, words: list[str]) -> Ragged:
        """Ids of each word (its spaces stand for the space mark), without begin and end."""
        self.tables()
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, counts = merge_words(self.pairs, self.of_character[points], lengths)
        odd = np.flatnonzero(symbols >= len(self.pieces))
        if not len(odd):
            return Ragged(symbols, counts)
        width = np.ones(len(symbols), np.int64)
        chars = [chr(symbols[i] - FOREIGN) if symbols[i] >= FOREIGN else self.names_of(symbols[i]) for i in odd]
        ids = [[self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown] for c in chars]
        width[odd] = [len(x) for x in ids]
        out = np.repeat(symbols, width)
        out[spread((np.cumsum(width) - width)[odd], width[odd])] = [i for x in ids for i in x]
        owner = np.repeat(np.arange(len(counts)), counts)
        return Ragged(out, np.bincount(owner, width, minlength=len(counts)).astype(np.int64))

    def names_of(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.of_character == symbol)[0]))

    def encode_batch(self, texts: pa.Array) -> Ragged:
        """Ids of every text of a batch, without begin and end ids."""
        return self._encoded([self.normalise(t)[0] for t in texts.to_pylist()])

    def _encoded(self, normal: list[str]) -> Ragged:
        """Ids of normalised texts.

        Texts are cut into runs of space marks with what follows, and line breaks; the distinct
        cuts are merged once. Texts holding the separator of the cuts, and those of models that
        merge across line breaks, take the units of ``encode``.
        """
        texts = pa.array(normal, pa.large_string())
        odd = pc.match_substring(texts, SEPARATOR).to_numpy(zero_copy_only=False) | self.merging_breaks
        alone = [np.array([i for unit in self.units.findall(t) for i in self.unit_ids(unit)[0]], np.int32) for t in texts.filter(pa.array(odd)).to_pylist()]
        some = texts.filter(pa.array(~odd))
        if pc.any(pc.match_substring(some, SPACE * 2)).as_py():
            some = pc.replace_substring_regex(some, f"({SPACE}+)", SEPARATOR + r"\1")
        else:
            some = pc.replace_substring(some, SPACE, SEPARATOR + SPACE)
        some = pc.replace_substring(some, "\n", f"{SEPARATOR}\n{SEPARATOR}")
        cuts = pc.split_pattern(some, SEPARATOR)
        coded = cuts.flatten().dictionary_encode()
        words = self.encode_words(coded.dictionary.to_pylist())
        counts = np.diff(cuts.offsets.to_numpy())
        ids = words.take(coded.indices.to_numpy()).merged_by(counts)
        if not alone:
            return ids
        other = Ragged(np.concatenate(alone), np.array([len(x) for x in alone]))
        return joined([np.flatnonzero(~odd), np.flatnonzero(odd)], [ids, other])

    def digests(self, texts: pa.Array) -> dict[str, list]:
        """Per text: number of ids, SHA-256 of ids and of the decoded text, checksum of span ends.

        Every text is normalised through the character map with its alignment; the pieces
        cover the normalised bytes, and a span end is the source byte that these align to. The ids
        get their begin and end, and the decoded bytes are those of the ids.
        """
        rows = pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()
        normal, aligned = zip(*map(self.normalise, rows), strict=True) if rows else ((), ())
        ids = self._encoded(list(normal))
        self.tables()
        shown = self.shown.take(ids.data)
        sizes = np.concatenate([[0], np.cumsum(shown.lengths)])
        covers = np.concatenate([[0], np.cumsum(self.covers[ids.data])])
        head, tail = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_crc32": []}
        for row, (a, n) in enumerate(zip(ids.starts.tolist(), ids.lengths.tolist(), strict=True)):
            own = ids.data[a : a + n]
            text = shown.data[sizes[a] : sizes[a + n]].tobytes()
            skip = 1 if n and self.dummy_prefix and self.pieces[own[0]].startswith(SPACE) else 0
            if not self.byte_ids and (own == self.unknown).any():  # an unknown piece covers what its character has
                ends = np.array([e for _, _, e in self.encode(rows[row])[1:-1]], "<u4")
            else:
                ends = aligned[row][covers[a + 1 : a + n + 1] - covers[a]].astype("<u4")
            out["n_tokens"].append(n + 2)
            out["ids_sha256"].append(hashlib.sha256(head + own.astype("<u4").tobytes() + tail).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(_whole(text[skip:])).hexdigest())
            out["spans_crc32"].append(zlib.crc32(ends.tobytes()))
        return out


def _whole(raw: bytes) -> bytes:
    """The same bytes where they are UTF-8, else mended."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return re.sub(rb"[\x80-\xff]+", _mend, raw)


def _mend(m: re.Match) -> bytes:
    """Each byte that starts no whole character becomes one replacement character."""
    raw, out, at = m.group(), b"", 0
    while at < len(raw):
        for width in (4, 3, 2):
            try:
                part = raw[at : at + width]
                if len(part) == width and len(part.decode()) == 1:
                    out, at = out + part, at + width
                    break
            except UnicodeDecodeError:
                continue
        else:
            out, at = out + "�".encode(), at + 1
    return out


_LOADED: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    """The model of a file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel.load(path)
    return _LOADED[path]


SPAN = "array<struct<id:int,start:int,end:int>>"


def encode_column(path: str, text: str) -> F.Column:
    """Pieces of a text column: (id, start byte, end byte) with begin and end ids."""

    @F.pandas_udf(SPAN)
    def encode(texts):
        model = loaded(path)
        return texts.map(lambda t: model.encode(t)).astype(object)

    return encode(F.coalesce(F.col(text), F.lit("")))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in slices(batch):
                found = model.digests(part["text"])
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], **found}, schema=_DIGESTS)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())]
)


def slices(batch: pa.RecordBatch, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``most`` bytes of text each, so that arrays stay small."""
    size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    start = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end
