"""The registered queries of the corpus operators: thin applications to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings."""
    from . import chat_format

    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_turns(turns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=85)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kit, lm_scoring

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = kit.crc_text("doc_id") % 7
    model = lm_scoring.train(docs, F.coalesce(remainder != 2, F.lit(True)))
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return lm_scoring.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five commits: all documents with stale counts (characters) in a stale group, then under another tokenizer
    version, then every stale count is revised and moves to its group, then the toxic ones leave, then the first batch is
    replayed and must change nothing."""
    from . import token_rollup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    store = token_rollup.RollupStore(spark)
    moved = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.col("lang").alias("source"), F.col("source").alias("lang"))
    stale = token_rollup.counts(moved, "words-1", F.length(F.coalesce("text", F.lit(""))))
    store.commit("load", stale)
    store.commit("recount", token_rollup.counts(docs, "alnum-2"))
    store.commit("revise", token_rollup.counts(docs, "words-1"))
    store.commit("purge", deletes=table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    store.commit("load", stale)
    return store.totals()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it leaks."""
    from . import decontamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kit, language_id

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = kit.crc_text("doc_id") % 3
    model = language_id.train(docs, F.coalesce(remainder != 1, F.lit(True)))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from . import html_extraction

    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh one are off by one."""
    from . import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    from . import lexical_search

    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
many AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT d.*, m.k IS NOT NULL AND d.doc_id <> m.last AS gone FROM keyed d LEFT JOIN many m ON d.k = m.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


# ORDER BY on text is by code point in both engines. formatted_chars repeats the template's arithmetic: a turn is
# "### role: text\n</turn>\n"; where the text holds an escaped control string, each ### gets one backslash. The
# tables hold no other texts that need escapes; the tests cover those.
OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(text) + 9 + CASE
         WHEN regexp_matches(text, '\\(###|</turn>)') THEN len(regexp_extract_all(text, '###'))
         ELSE 0 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
OP8_SQL = """
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'alnum-2', len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) FROM documents)
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
GROUP BY source, lang, tokenizer
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sized AS (SELECT r, doc_id, t, len(t) AS n FROM docs WHERE len(t) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
occurs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM occurs, totals GROUP BY term, nn),
scored AS (
  SELECT a.item_id, o.r, s.doc_id, CAST(sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 8 * (10 + (90 * s.n * nn) // ll)))) AS BIGINT) AS score
  FROM asked a JOIN occurs o USING (term) JOIN weights w USING (term) JOIN sized s ON s.r = o.r, totals GROUP BY a.item_id, o.r, s.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op8_token_rollup": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
