"""The queries of this subpackage with production parameters, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import ann, langid, licenses, lines, media, minhash, mixing, pieces, substring, toxicity
from ridgeline.llm._store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "pieces", "decoded_equal")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(F.coalesce(~held_out, F.lit(False))))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9).alias("score"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.text_media(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def pages_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved sequences of the raw pages: a row for each item."""
    found = media.sequences(_table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select(F.col("key").alias("page_id"), F.explode("items").alias("item")).select("page_id", *[f"item.{c}" for c in media.ITEM])


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.drop_repeats(_table(spark, sf_dir, "documents")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", lines.host(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    # the text is read twice, for the frequencies and for the lines that stay, and found once
    return lines.drop_boilerplate(materialize(pages), "host", "text").select("page_id", "host", "n_lines", "n_dropped", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda doc_id: F.coalesce(langid.fold(doc_id, 3) == 1, F.lit(False))
    out = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), lambda doc_id: ~held_out(doc_id))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_nearest, op3_minhash, op4_sentencepiece, op5_language, op6_licenses, op7_media, op8_substrings, op9_lines, op10_toxicity, pipeline, pages_sequences)}


OP1 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('17-' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER rest AS level FROM w
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, cap / weight <= level AS capped FROM l),
m AS (SELECT (SELECT level FROM c WHERE NOT capped ORDER BY cap / weight, place LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * common END AS target FROM c, m),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM e"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hit >= 80 * (x.n + y.n - hit)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
v AS (SELECT doc_id, u.p, array_to_string(w[u.p:u.p + {substring.WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS u(p)),
m AS (SELECT doc_id, p FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) > 1)),
x AS (SELECT DISTINCT doc_id, p + o.k AS i FROM m, range({substring.WINDOW}) AS o(k)),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

OP9 = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{lines.HOST}', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{lines.HIDDEN}', ' ', 'g'), '{lines.BREAKS}', chr(10), 'g'), '{lines.TAG}', '', 'g'), '{lines.SPACES}', ' ', 'g'), '(?: ?\n ?)+', chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') AS text FROM pages),
q AS (SELECT *, string_split(text, chr(10)) AS l FROM p),
f AS (SELECT host, unnest(list_distinct(l)) AS line FROM q WHERE host IS NOT NULL),
n AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT host, list(line) AS known FROM (SELECT host, line, count(*) AS k FROM f GROUP BY host, line) JOIN n USING (host) WHERE k > 1 AND k > pages * {lines.RATIO}::DOUBLE GROUP BY host),
k AS (SELECT page_id, q.host, l, CASE WHEN known IS NULL THEN l ELSE [x FOR x IN l IF NOT list_contains(known, x)] END AS kept FROM q LEFT JOIN b ON q.host = b.host)
SELECT page_id, host, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_dropped, CASE WHEN kept IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op3_minhash": OP3, "op6_licenses": licenses.oracle_sql(), "op8_substrings": OP8, "op9_lines": OP9}
