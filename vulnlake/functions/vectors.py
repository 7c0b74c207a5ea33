"""Vector column functions: cosine (T4) and the hashed token embedding (T5)."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.functions.text import tokens

EMBED_DIM = 64


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """T4: cosine similarity as double; null when either vector has norm zero.

    The guard matters: in Spark ``NaN >= 0.85`` is true, so a zero vector must not
    turn into NaN.
    """
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def token_buckets(text: Column, dim: int = EMBED_DIM) -> Column:
    """Hash bucket of every token: first 8 hex digits of its md5, modulo ``dim``."""
    return F.transform(
        tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"),
    )


def embed_hashed(text: Column, dim: int = EMBED_DIM) -> Column:
    """T5, built in: bag of hashed tokens as ``array<float>``; no shuffle."""

    @F.arrow_udf("array<float>")
    def counts(words: pa.Array) -> pa.Array:
        named = words.flatten().dictionary_encode()  # a word that comes often in a batch is hashed once
        bucket = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % dim for w in named.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        cells = np.bincount(row * dim + bucket[named.indices.to_numpy()], minlength=len(words) * dim) if len(row) else np.zeros(len(words) * dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(cells.astype(np.float32)))

    return counts(tokens(F.coalesce(text, F.lit(""))))
