"""Retrieval: A6, J2-J4, K1-K4, T3-T5, U3, U4, A7, J5, W3, W4, U6, A14, X1, C3."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.functions.vectors import cosine, embed_hashed
from vulnlake.operators import bm25, cache as ca, retrieval as rt, vectors as vc
from vulnlake.operators.ranking import top_k
from vulnlake.plans.retrieve import retrieve
from vulnlake.operators.replay import replay
from vulnlake.streaming.stream_cache import batch_cache


@query(sql("SELECT term, chunk_id, tf, len::BIGINT AS length, round(gain, 6) AS impact FROM gain JOIN tf USING (term, chunk_id) JOIN lengths USING (chunk_id)", "gain"))
def bm25_index(spark, d):
    index = bm25.build_bm25(v.chunks(spark, d))
    impact = F.round(F.col("idf") * F.col("gain"), 6)
    return index.postings.join(index.terms, "term").select(
        "term", "chunk_id", "tf", F.col("length").cast("bigint").alias("length"), impact.alias("impact")
    )


@query(sql("SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(idf), 6) FROM raw_idf) AS avg_idf FROM corpus", "raw_idf"))
def bm25_corpus_stats(spark, d):
    stats = bm25.build_bm25(v.chunks(spark, d)).corpus_stats
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


TURNS = """
WITH chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, text AS content FROM conversations),
queries AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations),
{tables},
pairs AS (SELECT q.query_id, c.chunk_id FROM queries q JOIN chunks c ON c.chunk_id = q.query_id + 1)
SELECT query_id, chunk_id, round(coalesce(sum(qtf * gain), 0), 6) AS score
FROM pairs LEFT JOIN query_terms USING (query_id) LEFT JOIN gain USING (chunk_id, term) GROUP BY ALL"""


@query(TURNS.format(tables=",\n".join(f"{n} AS MATERIALIZED ({v.SQL[n]})" for n in ("tf", "lengths", "corpus", "raw_idf", "idf", "gain", "query_terms"))))
def bm25_score(spark, d):
    """Every turn scored against the turn that follows it."""
    turns = v.table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    answers = turns.select(F.col("id").alias("chunk_id"), F.col("text").alias("content"))
    asked = turns.select(F.col("id").alias("query_id"), "text")
    pairs = asked.select("query_id", (F.col("query_id") + 1).alias("chunk_id")).join(answers.select("chunk_id"), "chunk_id")
    return bm25.bm25_score(pairs, asked, bm25.build_bm25(answers))


@query(sql("SELECT query_id, chunk_id, score, rank FROM bm25", "bm25"))
def bm25_top_k(spark, d):
    best = bm25.bm25_topk(v.queries(spark, d), v.stored_index(spark, d).bm25)
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(sql("""
SELECT query_id, md5(string_agg(content, repeat(chr(10), 2) ORDER BY rank)) AS digest, sum(length(content))::BIGINT AS chars
FROM bm25 JOIN chunks USING (chunk_id) GROUP BY query_id""", "bm25"))
def assemble_context(spark, d):
    chunks, queries = v.chunks(spark, d), v.queries(spark, d)
    best = bm25.bm25_topk(queries, v.stored_index(spark, d).bm25).join(chunks.select("chunk_id", "content"), "chunk_id")
    context = rt.assemble_context(queries.select("query_id"), best)
    chars = F.length("context") - 2  # two hits, one blank line between them
    return context.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), chars.cast("bigint").alias("chars"))


# A corpus of few words: a term in more than half of all chunks has a negative weight, where
# fewer than two chunks score above zero the best are those without any term of the query.
POOR = """
WITH chunks AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 3 THEN 'z' ELSE 'a b' || CASE WHEN doc_id % 3 > 0 THEN ' c' ELSE '' END END AS content FROM documents),
queries AS (SELECT item_id AS query_id, ['a', 'b a', 'q', 'c'][1 + item_id % 4] AS text FROM benchmark),
{tables},
scored AS (SELECT query_id, chunk_id, round(sum(qtf * gain), 6) AS score FROM query_terms JOIN gain USING (term) GROUP BY ALL),
every AS (SELECT q.query_id, c.chunk_id, coalesce(s.score, 0) AS score FROM queries q CROSS JOIN chunks c LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM every QUALIFY rank <= 2"""


@query(POOR.format(tables=",\n".join(f"{n} AS MATERIALIZED ({v.SQL[n]})" for n in ("tf", "lengths", "corpus", "raw_idf", "idf", "gain", "query_terms"))))
def bm25_negative_scores(spark, d):
    i = F.col("doc_id")
    content = F.when(i % 4 == 3, "z").otherwise(F.concat(F.lit("a b"), F.when(i % 3 > 0, " c").otherwise("")))
    chunks = v.table(spark, d, "documents").select(i.alias("chunk_id"), content.alias("content"))
    texts = F.array(*map(F.lit, ("a", "b a", "q", "c")))
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), texts[(F.col("item_id") % 4).cast("int")].alias("text"))
    best = bm25.bm25_topk(queries, bm25.build_bm25(chunks))
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def knn(spark, d, k=12):
    e = v.vectors(spark, d)
    return vc.vector_topk(
        e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding"), k
    )


@query(sql("""
SELECT vec_id, round(list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)), 6) AS similarity
FROM vectors JOIN (SELECT label, list(mean ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS mean FROM vectors, range(1, 65) t(i) GROUP BY ALL) GROUP BY label) USING (label)""", "vectors"))
def cosine_similarity(spark, d):
    """Each vector against the mean of its label."""
    e = v.vectors(spark, d)
    means = (
        e.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("m"))
    )
    return e.join(means, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("m")), 6).alias("similarity"))


@query(sql("SELECT query_id, chunk_id, score, rank FROM nearest", "nearest"))
def vector_candidates(spark, d):
    return knn(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query()
def vector_candidates_approximate(spark, d):
    """Nearest clusters only; recall is tested against the exact form."""
    e = v.vectors(spark, d)
    return vc.vector_topk(
        e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 4, probes=2
    )


@query("""
SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5""")
def top_k_per_query(spark, d):
    best = top_k(v.table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 5)
    return best.select("user_id", "event_id", "value", F.col("rank").cast("bigint").alias("rank"))


def _mmr_step(n: int) -> str:
    """SQL of pick ``n``: best gain among the candidates not picked before."""
    before = " UNION ALL ".join(f"SELECT query_id, chunk_id FROM p{i}" for i in range(1, n))
    return f"""
s{n} AS (SELECT query_id, chunk_id FROM ({before})),
g{n} AS (SELECT c.query_id, c.chunk_id, c.rank, c.score, round(0.5 * c.score - 0.5 * max(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))), 6) AS gain
  FROM nearest c JOIN s{n} s ON s.query_id = c.query_id JOIN vectors a ON a.vec_id = c.chunk_id JOIN vectors b ON b.vec_id = s.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM s{n} x WHERE x.query_id = c.query_id AND x.chunk_id = c.chunk_id) GROUP BY c.query_id, c.chunk_id, c.rank, c.score),
p{n} AS MATERIALIZED (SELECT query_id, chunk_id, score FROM g{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) = 1)"""


MMR = ", p1 AS (SELECT query_id, chunk_id, score FROM nearest WHERE rank = 1)," + ",".join(_mmr_step(n) for n in (2, 3, 4))
MMR += "\n" + " UNION ALL ".join(f"SELECT query_id, chunk_id, score, {n} AS rank FROM p{n}" for n in (1, 2, 3, 4))


@query(sql("", "nearest") + MMR)
def mmr(spark, d):
    e = v.vectors(spark, d)
    candidates = knn(spark, d).join(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    return vc.mmr(candidates).select("query_id", "chunk_id", "score", "rank")


@query("""
SELECT doc_id, bucket, count(*)::DOUBLE AS n FROM (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket FROM (
    SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM documents)) GROUP BY ALL""")
def embed_tokens(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", embed_hashed(F.col("text")).alias("e"))
    return docs.select("doc_id", F.posexplode("e").alias("bucket", "x")).where(F.col("x") > 0).select(
        "doc_id", "bucket", F.col("x").cast("double").alias("n")
    )


# Hybrid inputs: the nearest rows (three for every other query, all twelve for the rest), and twelve keyword rows per query whose
# contents repeat those of the vector side and each other.
HYBRID = """,
vec AS (SELECT n.query_id, n.chunk_id, 'label ' || n.label || ' ' || (n.chunk_id % 7) AS content, n.rank FROM nearest n WHERE n.rank <= CASE WHEN n.query_id % 2 = 0 THEN 3 ELSE 12 END),
word AS (SELECT c.query_id, c.chunk_id, 'label ' || c.label || ' ' || (c.chunk_id % 7) AS content,
    row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM nearest c),
fresh AS (SELECT * FROM word w WHERE NOT EXISTS (SELECT 1 FROM vec x WHERE x.query_id = w.query_id AND x.content = w.content)
  QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank, chunk_id) = 1)"""


def hybrid_inputs(spark, d):
    e = v.vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "label")
    near = knn(spark, d).join(e, "chunk_id").withColumn(
        "content", F.concat(F.lit("label "), v.text_of("label"), F.lit(" "), v.text_of(F.col("chunk_id") % 7))
    )
    near = near.select("query_id", "chunk_id", "content", "score", F.col("rank").cast("bigint").alias("rank"))
    few = F.when(F.col("query_id") % 2 == 0, 3).otherwise(12)
    return near.where(F.col("rank") <= few).drop("score"), near.withColumn("rank", 13 - F.col("rank")).drop("score")


@query(sql("", "nearest") + HYBRID + " SELECT query_id, chunk_id, content, rank FROM fresh")
def hybrid_dedupe(spark, d):
    vector, words = hybrid_inputs(spark, d)
    return rt.hybrid_dedupe(vector, words)


@query(sql("", "nearest") + HYBRID + """,
merged AS (SELECT *, 'vector' AS found_by FROM vec UNION ALL SELECT *, 'bm25' FROM fresh WHERE query_id IN (SELECT query_id FROM vec GROUP BY 1 HAVING count(*) < 4))
SELECT query_id, chunk_id, found_by, row_number() OVER (PARTITION BY query_id ORDER BY found_by DESC, rank, chunk_id) AS rank FROM merged""")
def union_retrieved(spark, d):
    vector, words = hybrid_inputs(spark, d)
    both = rt.union_retrieved(vector, words)
    return both.select("query_id", "chunk_id", "found_by", F.col("rank").cast("bigint").alias("rank"))


@query("""
SELECT source AS query_id, min(doc_id) AS chunk_id, md5(text) AS digest FROM documents GROUP BY source, text""")
def distinct_content(spark, d):
    docs = v.table(spark, d, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("doc_id").alias("rank")
    )
    return rt.distinct_content(docs).select("query_id", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(sql("""
, t AS (SELECT q.query_id, b.chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\\s+'), lambda x: x <> '')) AS a,
    list_distinct(list_filter(regexp_split_to_array(lower(c.content), '\\s+'), lambda x: x <> '')) AS b
  FROM bm25 b JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id))
SELECT query_id, chunk_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t""", "bm25"))
def rerank_top_k(spark, d):
    """BM25 hits rescored by token overlap."""
    chunks, queries = v.chunks(spark, d), v.queries(spark, d)
    hits = bm25.bm25_topk(queries, bm25.build_bm25(chunks)).join(chunks.select("chunk_id", "content"), "chunk_id")
    pairs = hits.join(queries.withColumnRenamed("text", "query"), "query_id")
    return rt.rerank(pairs).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


# The cache holds the newest hundred vectors.
CACHE = ", cache AS (SELECT vec_id AS seq, label, v FROM vectors ORDER BY vec_id DESC LIMIT 100)"
HITS = CACHE + """,
sims AS (SELECT k.vec_id, c.seq, list_dot_product(k.v, c.v) / sqrt(list_dot_product(k.v, k.v) * list_dot_product(c.v, c.v)) AS s FROM vectors k, cache c),
hits AS (SELECT vec_id, seq, round(s, 6) AS similarity FROM sims WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY seq) = 1)"""


def cache_of(spark, d):
    return v.vectors(spark, d).select(
        F.col("vec_id").alias("seq"), F.concat(F.lit("k"), v.text_of("vec_id")).alias("key"),
        v.text_of("label").alias("result"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


@query(sql("", "vectors") + HITS + """
SELECT k.vec_id, coalesce(h.seq, -1) AS hit_seq, coalesce(h.similarity, 0) AS similarity FROM vectors k LEFT JOIN hits h USING (vec_id)""")
def cache_lookup(spark, d):
    keys = v.vectors(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    hits, misses = ca.cache_lookup(keys, cache_of(spark, d))
    return hits.select("vec_id", "hit_seq", F.round("similarity", 6).alias("similarity")).unionByName(
        misses.select("vec_id", F.lit(-1).cast("bigint").alias("hit_seq"), F.lit(0.0).alias("similarity"))
    )


@query(sql("SELECT vec_id AS seq, 'k' || vec_id AS key FROM vectors ORDER BY vec_id DESC LIMIT 100", "vectors"))
def fifo_retain(spark, d):
    return ca.fifo_retain(cache_of(spark, d)).select("seq", "key")


@query("""
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def fifo_retain_per_key(spark, d):
    events = v.table(spark, d, "events").withColumn("seq", F.col("event_id"))
    return ca.fifo_retain(events, 20, ("user_id",)).select("user_id", "event_id")


@query(sql("", "vectors") + """,
fresh AS (SELECT 'k' || (vec_id * 3 // 2) AS key, min(vec_id) AS first, max_by(label, vec_id) AS result FROM vectors GROUP BY 1),
old AS (SELECT vec_id AS seq, 'k' || vec_id AS key, label AS result FROM vectors),
added AS (SELECT (SELECT max(vec_id) FROM vectors) + row_number() OVER (ORDER BY first) AS seq, key, result FROM fresh WHERE key NOT IN (SELECT key FROM old))
SELECT seq, key, CAST(result AS VARCHAR) AS result FROM (
  SELECT seq, key, coalesce(f.result, old.result) AS result FROM old LEFT JOIN fresh f USING (key) UNION ALL SELECT * FROM added) ORDER BY seq DESC LIMIT 100""")
def cache_append(spark, d):
    fresh = cache_of(spark, d).select(
        F.concat(F.lit("k"), v.text_of(F.floor(F.col("seq") * 3 / 2))).alias("key"), "embedding", "result", F.col("seq").alias("arrival")
    )
    return ca.cache_append(cache_of(spark, d), fresh).select("seq", "key", "result")


# One by one in the order of the ids, starting with the mean vector of every label as entries.
REPLAY = """
WITH RECURSIVE units AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS number, v, sqrt(list_dot_product(v, v)) AS length FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
means AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label),
entries AS (SELECT -row_number() OVER (ORDER BY label DESC) AS n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM means ORDER BY label DESC LIMIT 100),
walk AS (
  SELECT -1::BIGINT AS number, NULL::BIGINT AS vec_id, NULL::BIGINT AS source, (SELECT list({'n': n, 'u': u} ORDER BY n) FROM entries) AS held
  UNION ALL
  SELECT number, vec_id, coalesce(hit, number), CASE WHEN hit IS NULL THEN list_append(held, {'n': number, 'u': u})[-100:] ELSE held END
  FROM (SELECT *, list_filter(held, lambda e: list_dot_product(e.u, u) >= 0.85)[1].n AS hit
    FROM (SELECT x.number, x.vec_id, w.held, list_transform(x.v, lambda y: y / x.length) AS u FROM walk w JOIN units x ON x.number = w.number + 1)))
SELECT vec_id, number, source FROM walk WHERE number >= 0"""


@query(REPLAY)
def replay_cache(spark, d):
    e = v.vectors(spark, d).select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    entries = means.select(F.col("label").cast("bigint").alias("seq"), v.text_of("label").alias("key"), "embedding", v.text_of("label").alias("result"))
    return replay(e, entries).select(F.col("query_id").alias("vec_id"), "number", "source")


@query("SELECT true AS cache_enabled, count(*) AS cache_size, 100 AS max_size, 0.85::DOUBLE AS similarity_threshold FROM embeddings")
def cache_stats(spark, d):
    return ca.cache_stats(cache_of(spark, d))


@query("""
WITH RECURSIVE units AS MATERIALIZED (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
walk AS (
  SELECT label, 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::STRUCT(n BIGINT, s DOUBLE) AS hit, []::STRUCT(n BIGINT, u DOUBLE[])[] AS held FROM units WHERE i = 1
  UNION ALL
  SELECT label, i, vec_id, hit, CASE WHEN hit IS NULL THEN list_append(held, {'n': vec_id, 'u': u})[-100:] ELSE held END
  FROM (SELECT *, list_filter(list_transform(held, lambda e: {'n': e.n, 's': list_dot_product(e.u, u)}), lambda e: e.s >= 0.85)[1] AS hit
    FROM (SELECT x.label, x.i, x.vec_id, w.held, x.u FROM walk w JOIN units x ON x.label = w.label AND x.i = w.i + 1)))
SELECT label::VARCHAR AS type, vec_id AS seq, hit IS NOT NULL AS hit, hit.n AS hit_seq, round(hit.s, 6) AS similarity FROM walk WHERE i > 0""")
def stream_cache_batch(spark, d):
    """The vectors of each label one by one, as the stream answers them."""
    e = v.vectors(spark, d).select(v.text_of("label").alias("type"), F.col("vec_id").alias("seq"), "embedding")
    return batch_cache(e).withColumn("similarity", F.round("similarity", 6))


# Whole retrieval: token-count vectors of chunks and queries, four picks of the twelve nearest, keyword rows of other content,
# and the two best by token overlap.
WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> '')"
COUNTS = "list_transform(range(0, 64), lambda b: len(list_filter(buckets, lambda x: x = b))::DOUBLE)"
BUCKETS = "list_transform(" + WORDS + ", lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64)"
HYBRID_ALL = (
    f""",
vectors AS MATERIALIZED (SELECT chunk_id AS vec_id, {COUNTS} AS v FROM (SELECT chunk_id, {BUCKETS.format('content')} AS buckets FROM chunks) WHERE len(buckets) > 0),
asked AS MATERIALIZED (SELECT query_id, {COUNTS} AS v FROM (SELECT query_id, {BUCKETS.format('text')} AS buckets FROM queries) WHERE len(buckets) > 0),
nearest AS MATERIALIZED (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM asked a, vectors b QUALIFY rank <= 12),
p1 AS (SELECT query_id, chunk_id, score FROM nearest WHERE rank = 1),"""
    + ",".join(_mmr_step(n) for n in (2, 3, 4))
    + """,
picks AS ("""
    + " UNION ALL ".join(f"SELECT query_id, chunk_id, {n} AS rank FROM p{n}" for n in (1, 2, 3, 4))
    + f"""),
vec AS (SELECT query_id, chunk_id, content, rank FROM picks JOIN chunks USING (chunk_id)),
word AS (SELECT b.query_id, b.chunk_id, c.content, b.rank FROM bm25 b JOIN chunks c USING (chunk_id)),
fresh AS (SELECT * FROM word w WHERE NOT EXISTS (SELECT 1 FROM vec x WHERE x.query_id = w.query_id AND x.content = w.content)
  AND (SELECT count(*) FROM vec x WHERE x.query_id = w.query_id) < 6 QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank, chunk_id) = 1),
t AS (SELECT m.query_id, m.chunk_id, list_distinct({WORDS.format('q.text')}) AS a, list_distinct({WORDS.format('m.content')}) AS b
  FROM (SELECT * FROM vec UNION ALL SELECT * FROM fresh) m JOIN queries q USING (query_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) DESC, chunk_id) AS rank
FROM t QUALIFY rank <= 2"""
)


@query(sql("", "bm25") + HYBRID_ALL)
def hybrid_retrieval(spark, d):
    """Whole retrieval for the benchmark texts from the stored index."""
    found = retrieve(v.queries(spark, d), v.stored_index(spark, d), min_docs=6, use_reranking=True)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))
