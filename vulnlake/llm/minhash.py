"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 32 symbols of 16 bits, held as eight 64-bit chunks of four symbols. If two
signatures differ in at most 15 symbols, some chunk differs in at most one (pigeonhole), so
the two share one of the 8 x 4 keys "this chunk, one symbol left out". All pairs under that
distance therefore meet in a bucket. At the similarity that links (0.8) a symbol differs with
probability 0.2: a chunk has two errors or more in 18 pairs of 100, and a pair stays out of all
buckets only if every one of its chunks has (18 % to the eighth power, one pair in 900,000).
No pair that met is dropped for its signatures' distance.

* Documents with equal shingle sets form a class and continue as one row.
* A bucket is not expanded to its pairs. First a member meets the smallest members of its
  buckets (those it shares several with); verified links form components. Only members of
  buckets that then hold several components are compared across these: they must share a
  shingle of their prefixes, differ in few enough bits of a parity map (2048 bits, the parity of
  the shingles hashed to each: it never differs in more bits than the sets in shingles, so no
  link is lost), be near in a second signature of 1024 one-bit symbols (six standard deviations
  above what the linking similarity gives, one link in a billion), and pass the full sets.
* Links are confirmed on the full shingle sets, made again from the texts concerned.
* Components follow by alternating large-star and small-star steps, each written to the
  shared folder; every step aggregates by node before it joins.

Defined cases: a text with fewer than ``size`` words has its whole sequence as its only
shingle; null, empty and blank texts have no shingle and no link. Rows that repeat
a doc_id are linked with each other, and equal ones are compared once. Rows without an id are linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.llm.pieces import slices
from vulnlake.session import stage

SHINGLE = 4
CHUNKS, LANES = 8, 4
SYMBOLS = CHUNKS * LANES
RADIUS = CHUNKS * 2 - 1  # pairs of signatures that differ in so many symbols always share a key
PERCENT = 80
CHAINS, CHAIN = 1, 256  # rounds of chains through open buckets, and members of one chain
SUPPORT = 4  # keys that a member shares with a bucket's smallest member before they are compared
REMEMBERED = 1_000_000
_M = np.uint64(0xBF58476D1CE4E5B9)
SKETCH = 1024
#: differing sketch bits at PERCENT: a tenth of them, and six standard deviations
APART = int(SKETCH * 0.1 + 6 * np.sqrt(SKETCH * 0.1 * 0.9))
PARITY = 2048
FETCH = 1_000_000  # ids that may be broadcast (about 16 MB)
_BITS = np.random.default_rng(2025).integers(1, 2**63, (2, SKETCH), dtype=np.uint64) | np.uint64(1)
_SEEDS = np.random.default_rng(2024).integers(1, 2**63, (2, SYMBOLS), dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes (64 bits) of texts; word hashes are remembered per worker."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            h = np.array([known.get(w) or self._word(w) for w in words], np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Eight chunks of four 16-bit symbols; a symbol is a hash of the smallest permuted shingle."""
    least = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        least = np.minimum(least, ((part[:, None] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=0))
    symbols = (_mixed(least) >> np.uint64(40)) & np.uint64(0xFFFF)
    symbols = symbols.reshape(CHUNKS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(16))
    return np.bitwise_or.reduce(symbols, axis=1).view(np.int64)


def _hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.list_(pa.int64()))])


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_hash and signature (null without shingles) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for part in slices(batch):
                sets = [shingles.of(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n_shingles": [len(s) for s in sets],
                        "set_hash": [_hash(s) if len(s) else None for s in sets],
                        "signature": [signature(s) if len(s) else None for s in sets],
                    },
                    schema=_SIGNED,
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature array<long>")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A second signature of SKETCH one-bit symbols, as 64-bit words; for pairs the first one cannot tell."""
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 256):
        part = shingles[i : i + 256]
        least = np.minimum(least, ((part[:, None] ^ _BITS[0]) * _BITS[1]).min(axis=0))
    return np.packbits((_mixed(least) >> np.uint64(40) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles hashed to each of PARITY bits, as 64-bit words."""
    odd = np.bincount((_mixed(shingles) >> np.uint64(20)) % np.uint64(PARITY), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, size: int = SHINGLE, sketches: bool = False) -> DataFrame:
    """doc_id, its distinct shingle hashes and their hash (and their sketch and parity map)."""
    fields = [("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("set_hash", pa.binary())]
    more = [("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))]
    shape = pa.schema([*fields, *more] if sketches else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for part in slices(batch):
                sets = [shingles.of(t) for t in part["text"].to_pylist()]
                out = {"doc_id": part["doc_id"], "shingles": [x.view(np.int64) for x in sets], "set_hash": [_hash(x) for x in sets]}
                if sketches:
                    out |= {"sketch": [sketch(x) for x in sets], "parity": [parity_map(x) for x in sets]}
                yield pa.RecordBatch.from_pydict(out, schema=shape)

    columns = "doc_id long, shingles array<long>, set_hash binary" + (", sketch array<long>, parity array<long>" if sketches else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def _without_lane(lane: int) -> int:
    mask = ~(0xFFFF << (16 * lane)) & (2**64 - 1)
    return mask - 2**64 if mask >= 2**63 else mask


def bits_apart(a: Column, b: Column, bits: int) -> Column:
    """Number of differing bits of two bit arrays of ``bits`` bits."""
    out = F.lit(0)
    for i in range(bits // 64):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def _may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether parity maps, then sketches, leave a link possible (x, y: size, sketch, parity).

    Sets as similar as ``percent`` differ in (100 - percent) / (100 + percent) of their summed
    sizes at most, and parity maps in no more bits than the sets in shingles.
    """
    parities = bits_apart(x["parity"], y["parity"], PARITY) * (100 + percent) <= (x["size"] + y["size"]) * (100 - percent)
    return parities & (bits_apart(x["sketch"], y["sketch"], SKETCH) <= APART)


def _keys(signature: Column) -> Column:
    """The 32 bucket keys of a signature: chunk, lane left out, and the other three symbols."""
    rest = [
        (c * LANES + lane, signature[c].bitwiseAND(F.lit(_without_lane(lane)).cast("long"))) for c in range(CHUNKS) for lane in range(LANES)
    ]
    return F.array(*[F.xxhash64(F.lit(which), kept) for which, kept in rest])


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose doc_id is among ``ids`` (distinct).

    Up to ``FETCH`` ids, counted before, go to every task, so that neither texts nor sets are
    shuffled to be left out; more are joined by shuffle.
    """
    ids = stage(ids, "ids")
    return table.join(F.broadcast(ids) if ids.count() <= FETCH else ids, "doc_id", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that a similarity of ``percent`` allows."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _only(sets, _ends(pairs))
    left, right = (sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are near enough for the full sets to be worth fetching."""
    sets = _only(sets, _ends(pairs))
    facts = F.struct(F.size("shingles").alias("size"), "sketch", "parity")
    left, right = (sets.select(F.col("doc_id").alias(i), facts.alias(s)) for i, s in (("a", "x"), ("b", "y")))
    near = _may_link(*({c: F.col(s)[c] for c in ("size", "sketch", "parity")} for s in "xy"), percent)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Alternates large-star and small-star until the edges stay the same, which is read off a
    count and a checksum.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        for large in (True, False):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
            # written first, so that the join reads plain shuffles, whose hot nodes Spark can split
            least = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
            joined = both.join(least, "a")
            if large:  # larger neighbours move to the smallest
                moved = joined.where("b > a").select(F.col("m").alias("a"), "b")
            else:  # a node and its smaller neighbours move to the smallest
                moved = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
            edges = moved.where("a < b").distinct()
        edges = stage(edges, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components unfinished after {rounds} rounds")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _open_members(keyed: DataFrame, part: DataFrame) -> DataFrame:
    """(key, rep, component, members) of buckets with several components."""
    named = keyed.join(part.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("key", "rep", "component")
    spans = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    mixed = stage(spans.where("low <> high").select("key", "members"), "open-buckets")
    return stage(named.join(mixed, "key"), "open")


def _chain(held: DataFrame, turn: int) -> DataFrame:
    """Each member of an open bucket with the next one in a random order, where components differ.

    A quarter of the buckets does, as kin meet in many; what chains miss the prefixes find.
    Large buckets are cut into parts at random, so the order is made in bounded groups.
    """
    held = held.where(F.pmod("key", F.lit(4)) == turn % 4)
    order = F.xxhash64("rep", "key", F.lit(turn))
    cut = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("members") / CHAIN))
    row = Window.partitionBy("key", "cut").orderBy("place", "rep")
    placed = held.withColumn("cut", cut).withColumn("place", order)
    next_ = placed.select("rep", "component", F.lag("rep").over(row).alias("other"), F.lag("component").over(row).alias("theirs"))
    pairs = next_.where(F.col("component") != F.col("theirs"))
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _across(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among ``held`` (rep, component) that may be similar enough.

    Two sets of the wanted similarity share a shingle among the first few of each, if all are
    ordered alike (prefix filter); with rare shingles first, the edits that set a copy apart
    from its kin fill these places and meet nobody. A shingle's bucket compares the members
    outside its largest component with all of it, never that component with itself.
    """
    tokens = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle-counts")
    own = Window.partitionBy("rep", "size")
    ordered = tokens.join(counts, "token").withColumn("shared", F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "token")))
    # shingles of a single set come before all these, so they take the first size - shared places
    first = ordered.where(F.col("place") <= F.col("shared") - F.ceil(F.col("size") * percent / 100) + 1)
    prefixes = first.select("rep", "token", "size", "shared").join(held, "rep")
    prefixes = stage(prefixes.select("token", "rep", "component", "size", "shared"), "prefixes")
    sides = prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    sides = sides.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = prefixes.join(stage(sides.select("token", "main"), "open-shingles"), "token")
    open_ = stage(open_.join(sets.select(F.col("doc_id").alias("rep"), "sketch", "parity"), "rep"), "open-prefixes")
    columns = ("rep", "component", "size", "shared", "sketch", "parity")
    aside = open_.where("component <> main").select("token", "main", *[F.col(c).alias(c + "_a") for c in columns])
    everyone = open_.select("token", *[F.col(c).alias(c + "_b") for c in columns])
    # what only one set has cannot be common, which bounds the similarity of two sets
    most = F.least("shared_a", "shared_b")
    likely = most * 100 >= (F.col("size_a") + F.col("size_b") - most) * percent
    differ = F.col("component_a") != F.col("component_b")
    near = _may_link(*({c: F.col(f"{c}_{s}") for c in ("size", "sketch", "parity")} for s in "ab"), percent)
    once = (F.col("component_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b"))
    pairs = aside.join(everyone, (aside["token"] == everyone["token"]) & differ & once & likely & near)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several texts."""
    several = usable.select("doc_id", "set_hash").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = usable.join(several.select("doc_id"), "doc_id").select("doc_id", "set_hash").distinct()
    return texts.join(classes.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents.

    ``percent`` is PERCENT or more; the keys and the sketch limit are made for that.
    """
    if percent < PERCENT:
        raise ValueError(f"similarities below {PERCENT} % need other signatures")
    rows = stage(signed(docs, size), "signatures")
    usable = rows.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(
        usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    keyed = stage(classes.select("rep", F.explode(_keys(F.col("signature"))).alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stage(shared.select("key", "first"), "buckets")
    keyed = stage(keyed.join(shared, "key"), "shared-keys")  # from here on only buckets that several share
    met = keyed.where("rep <> first").groupBy("first", "rep").agg(F.count(F.lit(1)).alias("n"))
    starred = met.where(F.col("n") >= SUPPORT).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    sizes = classes.select("rep", "n")
    met = starred.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    first = stage(met.where(_alike(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), "star-pairs")
    repeated = stage(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids")

    def sets_of(ids: DataFrame, sketches: bool) -> DataFrame:
        """The sets of some ids; equal rows of a repeated id give one."""
        some = _only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
        sets = stage(shingle_sets(some, size, sketches), "sets")
        if repeated.isEmpty():
            return sets
        several = sets.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_hash"])
        return stage(sets.join(repeated, "doc_id", "left_anti").unionByName(several), "sets")

    links = stage(_confirmed(first, sets_of(_ends(first), False), percent).unionByName(_same_id(usable, classes)), "links")
    part = stage(components(links), "components")

    # Members of buckets that still hold several components are compared across these: first
    # in chains, which join most of what belongs together, then as the prefixes say.
    held = _open_members(keyed, part)
    sets = sets_of(held.select(F.col("rep").alias("doc_id")).distinct(), True)
    for turn in range(CHAINS):
        chained = stage(_near(stage(_chain(held, turn), "chained"), sets, percent), "chain-pairs")
        links = stage(links.unionByName(_confirmed(chained, sets, percent)), "links")
        part = stage(components(links), "components")
        held = _open_members(keyed, part)
    second = stage(_across(held.select("rep", "component").distinct(), sets, percent), "across-pairs")
    more = _confirmed(second, sets, percent)
    final = stage(components(links.unionByName(more)), "components")

    moved = classes.select("set_hash", "rep").join(final.toDF("rep", "component_id"), "rep", "left")
    placed = moved.select("set_hash", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(placed, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
