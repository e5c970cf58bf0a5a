"""Full-text, vector and hybrid search; reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import embedding, hybrid, vector
from ..operators.fulltext import TextIndex
from ..operators.ranking import with_position
from ..storage import shared_dir
from .fixtures import database, loader, pivot_index, query_vector, spread
from .registry import query

_TOKENS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


def _bm25_sql(terms: list[str], keep: str = "true", limit: int | None = 50) -> str:
    """BM25 over all documents; each term is a test of a token t."""
    tf = ", ".join(f"len(list_filter(k, lambda t: {c})) AS tf{i}" for i, c in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"ln((n - df{i} + 0.5) / (df{i} + 0.5))"
    part = " + ".join(f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
WITH k AS (SELECT doc_id, lang, {_TOKENS} AS k FROM documents),
c AS (SELECT doc_id, lang, len(k) AS dl, {tf} FROM k),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c),
r AS (SELECT doc_id AS id, lang, {part} AS raw FROM c, s WHERE ({hit}))
SELECT id, round(raw, 6) AS score FROM r WHERE {keep} ORDER BY raw DESC, id {f"LIMIT {limit}" if limit else ""}
"""


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS tokens_md5 FROM documents")
def text_tokens(spark, d):
    k = tx.tokens(F.coalesce("text", F.lit("")))
    return spread(loader(spark, d)("documents").select("doc_id", "text")).select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", k)).alias("tokens_md5"))


def _keyword(spark, d, text, limit=50, **filters):
    q = database(spark, d).table("docs")
    for name, value in filters.items():
        q = q.eq(name, value)
    ranked = q.keyword_search(text, "content", limit).select("id").frame()
    return ranked.select("id", F.round("_score", 6).alias("score"))


@query(_bm25_sql(["starts_with(t, 'idiot')", "starts_with(t, 'worthless')"]))
def text_keyword_bm25(spark, d):
    return _keyword(spark, d, "idiot worthless")


@query(_bm25_sql(["starts_with(t, 'tion')", "starts_with(t, '2025')", "t = 'fy'"]))
def text_keyword_prefix(spark, d):
    return _keyword(spark, d, "tion FY2025")


@query(_bm25_sql(["starts_with(t, 'worth')", "starts_with(t, 'moron')"], "lang = 'en'"))
def text_keyword_filtered(spark, d):
    """Statistics stay those of the whole column; the filter only restricts what comes out."""
    return _keyword(spark, d, "worth moron", lang="en")


_PHRASE = """
WITH k AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS k FROM documents),
c AS (SELECT id, len(k) AS dl, CAST(len(list_filter(range(1, greatest(len(k), 1)), lambda i: k[i] = 'of' AND k[i + 1] = 'the')) AS BIGINT) AS tf FROM k),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM c)
SELECT id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE tf > 0
"""


@query(_bm25_sql(["starts_with(t, 'the')", "starts_with(t, 'worthless')"], limit=5))
def text_keyword_top(spark, d):
    """The five best of a common and a rare word: blocks that cannot hold one of them are not read."""
    return _keyword(spark, d, "the worthless", limit=5)


@query(_PHRASE)
def text_phrase(spark, d):
    ranked = database(spark, d).table("docs").fts("Of the", "content", None).select("id").frame()
    return ranked.select("id", F.round("_score", 6).alias("score"))


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)\\bidiot\\b')")
def text_regex(spark, d):
    return database(spark, d).table("docs").regex_search(r"\bidiot\b", "content").select("id").frame()


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)(the|of|and)\\s+[a-z]+') AND translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%idiot%'")
def text_regex_ilike(spark, d):
    """Two patterns, both met from the substring index before any text is read."""
    return database(spark, d).table("docs").ilike("content", "IDIOT").regex_search(r"(the|of|and)\s+[a-z]+", "content").select("id").frame()


@query("SELECT id, 1 - CAST(n - 1 AS DOUBLE) / (total - 1) AS score FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents), (SELECT count(*) AS total FROM documents)")
def text_position_score(spark, d):
    """The fallback score by position, 1 to 0."""
    docs = loader(spark, d)("documents").select(F.col("doc_id").alias("id"), "n_chars")
    ranked = with_position(docs, F.desc("n_chars"), F.asc("id"))
    return ranked.select("id", F.when(F.col("total") == 1, 1.0).otherwise(1 - F.col("position") / (F.col("total") - 1)).alias("score"))


_K = f"SELECT doc_id, {_TOKENS} AS k FROM documents"


@query(f"SELECT count(*) AS documents, CAST(sum(len(k)) AS BIGINT) AS tokens, (SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest(k) FROM ({_K}))) AS postings FROM ({_K})")
def text_index_build(spark, d):
    """A full-text index from scratch: documents, tokens and postings."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.update(loader(spark, d)("documents"), "doc_id", "text")
    return index.statistics().join(F.broadcast(index.postings(F.lit(True), places=False).agg(F.count("*").alias("postings"))))  # one row


_CHANGED = """SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'a worthless note of the ' || lang WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id + 100000000, lang, 'new: ' || lang || ' worthless of the of the' FROM documents WHERE doc_id % 17 = 0"""


def _index_after_writes(spark, d, compact):
    """An index of all documents, then replaced and emptied texts, deleted and new documents."""
    docs = loader(spark, d)("documents").select("doc_id", "text", "lang")
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.update(docs, "doc_id", "text")
    index.update(docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("a worthless note of the "), "lang")), "doc_id", "text")
    index.update(docs.where("doc_id % 13 = 0 AND doc_id % 7 <> 0").withColumn("text", F.lit(None).cast("string")), "doc_id", "text")
    index.delete(docs.where("doc_id % 11 = 0").unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(-5).cast("long"))), "doc_id")
    index.update(docs.where("doc_id % 17 = 0").select((F.col("doc_id") + 100000000).alias("doc_id"), F.concat(F.lit("new: "), "lang", F.lit(" worthless of the of the")).alias("text")), "doc_id", "text")
    if compact:
        index.compact()
    return index


@query(_bm25_sql(["starts_with(t, 'worthless')", "starts_with(t, 'idiot')"], limit=None).replace("FROM documents)", f"FROM ({_CHANGED}))", 1))
def text_index_update(spark, d):
    ranked = _index_after_writes(spark, d, False).bm25(tx.parse_keywords("worthless idiot"))
    return ranked.select("id", F.round(-F.col("rank"), 6).alias("score"))


@query(_PHRASE.replace("FROM documents)", f"FROM ({_CHANGED}))", 1))
def text_index_compacted(spark, d):
    ranked = _index_after_writes(spark, d, True).bm25([tx.Term(("of", "the"))])
    return ranked.select("id", F.round(-F.col("rank"), 6).alias("score"))


_UNIT = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_QV = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_cosine_similarity(v, q)"


@query(f"SELECT id, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first FROM (SELECT id, list_transform(v, lambda x: x / CASE WHEN s = 0 THEN 1 ELSE s END) AS u FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS s FROM ({_UNIT})))")
def vec_normalize(spark, d):
    u = loader(spark, d)("embeddings").select(F.col("vec_id").alias("id"), vector.normalize(F.col("embedding")).alias("u"))
    square = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return u.select("id", F.round(square, 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} ORDER BY {_COS} DESC, id LIMIT 20")
def vec_topk(spark, d):
    rows = loader(spark, d)("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.top_k(rows, "id", "vector", query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} ORDER BY {_COS} DESC, id LIMIT 20")
def vec_topk_pivots(spark, d):
    """The same rows, of which only the groups are read that can hold one of the best."""
    return pivot_index(spark, d).search(query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY {_COS} DESC, id LIMIT 15")
def vec_filtered_pivots(spark, d):
    """Predicates filter before the search, which goes by pivots."""
    q = database(spark, d, pivots=True).table("docs").eq("lang", "en").order("n_chars").vector_search(query_vector(spark, d), "embedding", 15)
    return q.select("id").frame().select("id", F.round("_score", 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} WHERE id % 4 <> 0 ORDER BY {_COS} DESC, id LIMIT 20")
def vec_topk_broken(spark, d):
    """A quarter of the vectors has a null, NaN or infinite element, or none at all: they are no results."""
    v, i = F.col("embedding").cast("array<float>"), F.col("vec_id")
    bad = lambda x: F.concat(F.slice(v, 1, 5), F.array(x.cast("float")), F.slice(v, 7, 10_000))
    made = F.when(i % 16 == 0, bad(F.lit(None))).when(i % 16 == 4, bad(F.lit(float("nan")))).when(i % 16 == 8, bad(F.lit(float("inf")))).when(i % 4 != 0, v)
    rows = loader(spark, d)("embeddings").select(i.alias("id"), made.alias("vector"))
    return vector.top_k(rows, "id", "vector", query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV}")
def vec_cosine_builtin(spark, d):
    """The same score by built-in array functions, for all rows."""
    rows = loader(spark, d)("embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.round(vector.cosine(F.col("embedding"), query_vector(spark, d)), 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY {_COS} DESC, id LIMIT 15")
def vec_topk_filtered(spark, d):
    q = database(spark, d).table("docs").eq("lang", "en").order("n_chars").vector_search(query_vector(spark, d), "embedding", 15)
    return q.select("id").frame().select("id", F.round("_score", 6).alias("score"))


@query(f"SELECT id, round({_COS}, 6) AS score FROM ({_UNIT}), {_QV} WHERE id % 3 <> 0 ORDER BY {_COS} DESC, id LIMIT 20")
def vec_tombstone(spark, d):
    """A version with a third of all vectors removed; removed ids never come out."""
    base = loader(spark, d)("embeddings").select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("version"), F.col("embedding").cast("array<float>").alias("vector"))
    gone = base.where("id % 3 = 0").select("id", F.lit(2).cast("long").alias("version"), F.lit(None).cast("array<float>").alias("vector"))
    rows = vector.latest(base.unionByName(gone))
    return vector.top_k(rows, "id", "vector", query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS id, CAST(label + 1 AS BIGINT) AS version FROM embeddings WHERE label % 2 = 1 UNION ALL SELECT vec_id, 0 FROM embeddings WHERE label % 2 = 0")
def dedupe_latest_version(spark, d):
    base = loader(spark, d)("embeddings").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("version"), F.col("embedding").alias("vector"), "label")
    newer = base.where("label % 2 = 1").withColumn("version", (F.col("label") + 1).cast("long"))
    both = base.unionByName(newer).withColumn("was", F.col("version"))
    return vector.latest(both).select("id", F.col("was").alias("version"))


_LEGS = f"""
WITH base AS (SELECT doc_id AS id FROM documents WHERE lang = 'en'),
v AS (SELECT id, {_COS} AS cos FROM ({_UNIT}), {_QV} WHERE id IN (SELECT id FROM base) ORDER BY cos DESC, id LIMIT 60),
kk AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS k FROM documents),
c AS (SELECT id, len(k) AS dl, len(list_filter(k, lambda t: starts_with(t, 'idiot'))) AS tf0, len(list_filter(k, lambda t: starts_with(t, 'moron'))) AS tf1 FROM kk),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c),
w AS (SELECT id, greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
             + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm
      FROM c, s WHERE (tf0 > 0 OR tf1 > 0) AND id IN (SELECT id FROM base) ORDER BY bm DESC, id LIMIT 60),
vn AS (SELECT id, cos, CASE WHEN max(cos) OVER () = min(cos) OVER () THEN 1 ELSE (cos - min(cos) OVER ()) / (max(cos) OVER () - min(cos) OVER ()) END AS v FROM v),
wn AS (SELECT id, bm, CASE WHEN max(bm) OVER () = min(bm) OVER () THEN 1 ELSE (bm - min(bm) OVER ()) / (max(bm) OVER () - min(bm) OVER ()) END AS k FROM w),
f AS (SELECT coalesce(vn.id, wn.id) AS id, coalesce(v, 0) AS v, coalesce(k, 0) AS k, cos, bm FROM vn FULL JOIN wn ON vn.id = wn.id)
"""


def _fused(alpha: float) -> str:
    score = f"({alpha} * v + {1 - alpha} * k)"
    return _LEGS + f"SELECT id, round({score}, 6) AS score FROM f ORDER BY {score} DESC, cos IS NULL, cos DESC, bm DESC, id LIMIT 20"


def _hybrid(spark, d, alpha):
    q = database(spark, d).table("docs").eq("lang", "en")
    out = q.hybrid_search("idiot moron", "embedding", "content", 20, alpha, vector_query=query_vector(spark, d)).select("id").frame()
    return out.select("id", F.round("_score", 6).alias("score"))


@query(_fused(0.75))
def hybrid_fusion(spark, d):
    return _hybrid(spark, d, 0.75)


@query(_fused(0.0))
def hybrid_alpha0(spark, d):
    return _hybrid(spark, d, 0.0)


@query(_fused(1.0))
def hybrid_alpha1(spark, d):
    return _hybrid(spark, d, 1.0)


@query("SELECT doc_id AS id, round(CASE WHEN hi = lo THEN 1 ELSE (n_chars - lo) / CAST(hi - lo AS DOUBLE) END, 9) AS scaled FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)")
def hybrid_minmax(spark, d):
    rows = loader(spark, d)("documents").select(F.col("doc_id").alias("id"), "n_chars")
    return hybrid.minmax(rows, "n_chars", "scaled").select("id", F.round("scaled", 9).alias("scaled"))


@query(f"""
WITH t AS (SELECT id, {_COS} AS cos FROM ({_UNIT}), {_QV} WHERE id IN (SELECT doc_id FROM documents) ORDER BY cos DESC, id LIMIT 100),
r AS (SELECT t.id, cos, len(list_intersect(list_distinct(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')), ['idiot', 'moron', 'the'])) / 3.0 AS rel FROM t JOIN documents ON doc_id = t.id)
SELECT id, round(rel, 6) AS score, round(cos, 6) AS original_score FROM r ORDER BY rel DESC, cos DESC, id LIMIT 10
""")
def rerank_lexical(spark, d):
    q = database(spark, d).table("docs").vector_search(query_vector(spark, d), "embedding", 100).rerank("the idiot moron", "content", 10)
    return q.select("id").frame().select("id", F.round("_score", 6).alias("score"), F.round("original__score", 6).alias("original_score"))


@query(f"""
WITH a AS (SELECT id, {_COS} AS cos FROM ({_UNIT}), {_QV} WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY cos DESC, id LIMIT 20),
b AS (SELECT id, {_COS} AS cos FROM ({_UNIT}), {_QV} WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr') ORDER BY cos DESC, id LIMIT 20),
u AS (SELECT 'english' AS type, * FROM a UNION ALL SELECT 'french', * FROM b)
SELECT type, id, round(cos, 6) AS score FROM u ORDER BY cos DESC, type, id LIMIT 10
""")
def union_legs_topk(spark, d):
    db, q = database(spark, d), query_vector(spark, d)
    leg = lambda lang: db.table("docs").eq("lang", lang).vector_search(q, "embedding", 20).select("id").frame().withColumnRenamed("_score", "score")
    best = hybrid.union_legs({"english": leg("en"), "french": leg("fr")}, 10)
    return best.select("type", "id", F.round("score", 6).alias("score"))


@query("""
WITH cache AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS id, sha256(coalesce(text, '')) IN (SELECT sha FROM cache) AS hit FROM documents
""")
def embed_cache_split(spark, d):
    """Texts whose hash is cached, and those to embed."""
    docs = loader(spark, d)("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    cache = docs.where("id % 3 = 0").select(F.sha2("text", 256).alias("sha256"), F.array(F.lit(1.0)).alias("vector"))
    hit, miss = vector.split_cached(docs, cache)
    return hit.select("id", F.lit(True).alias("hit")).unionByName(miss.select("id", F.lit(False).alias("hit")))


@query("SELECT doc_id AS row_id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0")
def outbox_retry(spark, d):
    """Failed texts recorded twice stay once; those embedded later leave."""
    docs = loader(spark, d)("documents").where("doc_id % 5 = 0")
    failed = docs.select(F.lit("documents").alias("table_name"), F.lit("text").alias("column_name"), F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = spark.createDataFrame([], "table_name string, column_name string, row_id long, text string, text_sha256 string, created_at timestamp")
    once = vector.outbox_add(empty, failed.unionByName(failed))
    twice = vector.outbox_add(once, failed)
    return vector.outbox_done(twice, twice.where("row_id % 10 = 0")).select("row_id")


def _lengths(texts):
    """A plain embedder: length, words by spaces, 1."""
    if any("worthless" in t for t in texts):
        raise RuntimeError("refused")
    return [(float(len(t)), float(t.count(" ")), 1.0) for t in texts]


_AFTER = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' more' WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, text AS old FROM documents WHERE doc_id % 4 <> 1"


@query(f"""
WITH a AS ({_AFTER}), q AS (SELECT doc_id, text FROM a WHERE trim(text, chr(32)) <> '' AND text <> coalesce(old, '')),
bad AS (SELECT DISTINCT text FROM q WHERE contains(text, 'worthless'))
SELECT doc_id AS id, CASE WHEN text IN (SELECT text FROM q WHERE doc_id % 9 = 0) THEN -1 WHEN text IN (SELECT text FROM bad) THEN NULL ELSE len(text) END::DOUBLE AS length FROM q
""")
def embed_after_write(spark, d):
    """What a write changed is embedded, one text a request; cached texts are not sent, and refused ones go to the outbox."""
    before = loader(spark, d)("documents").select(F.col("doc_id").alias("id"), "text")
    after = before.where("id % 4 <> 1").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))).when(F.col("id") % 5 == 0, "").otherwise(F.col("text")))
    queue = embedding.changed_texts(before, after, "id", "text")
    cached = queue.where("id % 9 = 0").select(F.sha2("text", 256).alias("sha256"), F.array(F.lit(-1.0)).alias("vector"))
    done, failed = embedding.flush(queue, "id", "text", _lengths, cached, "documents", "text", most=1)
    left = failed.select(F.col("row_id").alias("id"), F.lit(None).cast("double").alias("length"))
    return done.select("id", F.col("vector")[0].alias("length")).unionByName(left)


class _Flaky:
    """Fails every second request of a task; whether a text is embedded depends on when it is asked for."""

    def __init__(self):
        self.asked = 0

    def __call__(self, texts):
        self.asked += 1
        if self.asked % 2:
            raise TimeoutError("try later")
        return [(float(len(t)),) for t in texts]


@query("SELECT doc_id AS id, 1::BIGINT AS results, true AS sound FROM documents WHERE trim(text, chr(32)) <> ''")
def embed_flaky(spark, d):
    """Each queued text is either embedded or in the outbox, though a second look at the embedder would answer otherwise."""
    docs = loader(spark, d)("documents").select(F.col("doc_id").alias("id"), "text")
    queue = embedding.changed_texts(docs.limit(0), docs, "id", "text")
    none = spark.createDataFrame([], "sha256 string, vector array<double>")
    done, failed = embedding.flush(queue, "id", "text", _Flaky(), none, "documents", "text", most=3)
    both = done.select("id", F.col("vector")[0].alias("length")).unionByName(failed.select(F.col("row_id").alias("id"), F.lit(None).cast("double").alias("length")))
    met = queue.join(both, "id").withColumn("sound", F.coalesce(F.col("length") == F.length("text"), F.lit(True)))
    return met.groupBy("id").agg(F.count("*").alias("results"), F.bool_and("sound").alias("sound"))


@query("SELECT doc_id // 50 AS d, doc_id AS i, CAST(n_chars AS DOUBLE) AS own, CAST(count(*) OVER (PARTITION BY doc_id // 50) AS DOUBLE) AS chunks FROM documents")
def embed_contextual(spark, d):
    """Chunks of a document are embedded beside each other; documents above the budget are cut and put together again."""
    chunks = loader(spark, d)("documents").select(F.floor(F.col("doc_id") / 50).cast("long").alias("d"), F.col("doc_id").alias("i"), F.repeat(F.lit("x "), 20).alias("text"), "n_chars")
    made = embedding.embed_chunks(chunks, "d", "i", "text", lambda documents: [[(len(t), len(c)) for t in c] for c in documents])
    met = made.join(chunks.select("d", "i", "n_chars"), ["d", "i"]).where("error IS NULL AND vector[0] = 40")
    return met.select("d", "i", F.col("n_chars").cast("double").alias("own"), F.col("vector")[1].alias("chunks"))


@query("SELECT 'documents' AS table_name, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'summary' END AS column_name, count(*) AS texts FROM documents WHERE doc_id % 5 = 0 GROUP BY ALL")
def outbox_groups(spark, d):
    """What waits in the outbox, by table and column."""
    docs = loader(spark, d)("documents").where("doc_id % 5 = 0")
    failed = docs.select(F.lit("documents").alias("table_name"), F.when(F.col("doc_id") % 2 == 0, "text").otherwise("summary").alias("column_name"), F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = spark.createDataFrame([], "table_name string, column_name string, row_id long, text string, text_sha256 string, created_at timestamp")
    return embedding.outbox_groups(vector.outbox_add(empty, failed)).select("table_name", "column_name", "texts")
