"""One query per operator over whole tables, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import ann_tree, hamming_topk, langid, minhash, packing, pieces, quality, quality_votes, runs, secret_scan, toxicity, va_file, warc
from vulnlake.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; its package is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.language(net, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of the 64-d embeddings; queries are the ids divisible by 50."""
    return hamming_topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, bits=64)


_CODE = " || ".join(f"(embedding[{i + 1}] > 0)::INT::VARCHAR" for i in range(64))
ORACLES["op6_hamming"] = f"""
WITH c AS (SELECT vec_id, min({_CODE}) AS code FROM embeddings GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, c.vec_id, hamming(q.code, c.code)::INTEGER AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM d
QUALIFY rank <= 10
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_of("base", k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    digest = F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.written(F.col("spans")).alias("spans"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {hex}, 5))::INTEGER >> {shift}) % 32, 1)"
ORACLES["op9_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, html, sha1(html) AS h FROM p),
top AS (SELECT html, max(page_id) AS first FROM p WHERE page_id IS NOT NULL GROUP BY html)
SELECT page_id, payload_bytes,
  {' || '.join(_BASE32.format(hex=5 * i + 1, shift=s) for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM hashed LEFT JOIN top USING (html)
"""


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
either_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN either_way b ON r.y = b.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = x
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = va_file.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "sha2(concat('1:', cast(key AS string)), 256)")
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _kmeans_sql(rounds: int = 3, k: int = 16) -> str:
    away = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = [
        f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""
a{t} AS MATERIALIZED (SELECT r, vec_id, v, k, {away} AS distance FROM v, c{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""
s{t} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) t(i) GROUP BY k, i),
n{t} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY k),
c{t + 1} AS MATERIALIZED (SELECT k, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (k))"""
            )
    return f"""
WITH {','.join(steps)}
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLES["op11_centroids"] = _kmeans_sql()


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), altered=True))


# A run holds 16 equal words one period apart, so equal 16-word windows of a text find them all.
ORACLES["op12_runs"] = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(doc_id::VARCHAR))), lambda c, t:
      (xor(CASE WHEN t % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (t // 8 + 1)::INTEGER, 1))) ELSE c END >> 1,
        3988292384 * ((CASE WHEN t % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (t // 8 + 1)::INTEGER, 1))) ELSE c END) & 1)))), 4294967295) AS h
  FROM documents),
s AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS cut, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM w),
x AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN cut THEN list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + e)) ELSE i END + 1]) ELSE w END AS w FROM s),
g AS MATERIALIZED (SELECT r, n, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM x, unnest(range(0, n - 15)) t(i)),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM m),
stretch AS (SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM isles GROUP BY r, q, isle),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretch WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) t(i)),
words AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS word FROM x),
left_ AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
all_ AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(all_.t, '')) AS runs_sha256, sha256(coalesce(left_.t, '')) AS collapsed_sha256
FROM x LEFT JOIN all_ USING (r) LEFT JOIN best USING (r) LEFT JOIN left_ USING (r)
"""


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_votes.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _votes_sql() -> str:
    q = quality_votes
    n = range(len(q.RULES))
    spaces = q.SPACES
    steps = [
        rf"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + {q.WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(words) - {q.WINDOW - 2})) t(i)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g JOIN twice USING (r, g), range({q.WINDOW}) t(k) GROUP BY r),
counts AS MATERIALIZED (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{spaces}', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '{q.SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
  length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters,
  length(text) - length(translate(text, '!', '')) AS n_loud,
  len(list_intersect(list_distinct(words), {sorted(set(q.STOP_WORDS))})) AS n_stop FROM w LEFT JOIN rep USING (r)),
voted AS MATERIALIZED (SELECT *, {', '.join(f'{q.vote_sql(rule)} AS v{j}' for j, rule in enumerate(q.RULES))} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join(f'v{j}' for j in n)}, count(*) AS n FROM voted GROUP BY ALL),
m0 AS (SELECT {q.START}::DOUBLE AS pi, {', '.join(f'{q.START}::DOUBLE AS g{j}, {q.START}::DOUBLE AS b{j}' for j in n)})"""
    ]
    odds = q.log_odds_sql("pi", [f"g{j}" for j in n], [f"b{j}" for j in n], [f"v{j}" for j in n])
    for t in range(q.ROUNDS):
        rates = [f"{q.rate_sql('coalesce(sum(n * p), 0)', 'coalesce(sum(n), 0)')} AS pi"]
        for j in n:
            good = q.rate_sql(f"coalesce(sum(n * p) FILTER (v{j} = 1), 0)", f"coalesce(sum(n * p) FILTER (v{j} <> 0), 0)")
            bad = q.rate_sql(f"coalesce(sum(n * (1 - p)) FILTER (v{j} = -1), 0)", f"coalesce(sum(n * (1 - p)) FILTER (v{j} <> 0), 0)")
            rates += [f"{good} AS g{j}", f"{bad} AS b{j}"]
        steps.append(
            f"""
p{t} AS (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns, m{t}),
m{t + 1} AS MATERIALIZED (SELECT {', '.join(rates)} FROM p{t})"""
        )
    return f"""
WITH {','.join(steps)}
SELECT doc_id, {', '.join(f'{c}::BIGINT AS {c}' for c in ('n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words'))},
  {q.BASE_FAILED} AS base_failed, NOT ({q.BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= {q.KEEP} AS kept
FROM voted, m{q.ROUNDS}
"""


ORACLES["op13_quality_rules"] = _votes_sql()
