"""One query per operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reach_workers(spark: SparkSession) -> None:
    """Python workers of this machine find the package where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _reach_workers(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return register


@_query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    from tidemark.llm.language import fit_language_model, held_out, predict_language

    docs = _table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out("doc_id")))
    found = predict_language(docs, model, "doc_id", "text", {"held_out": held_out("doc_id")})
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


@_query("op8_line_chunks", r"""
WITH t AS (SELECT DISTINCT doc_id, md5(text) AS k, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, len(l) AS n, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM t),
r AS (SELECT *, list_transform(range(1, n), lambda i: (31 * h[i] + h[i + 1]) % 65521) AS r FROM h),
e AS (SELECT doc_id, k, l, n,
             list_append(list_filter(range(2, n - 1), lambda i: r[i] < r[i - 1] AND r[i] <= r[i + 1]), n) AS ends FROM r),
c AS (SELECT doc_id, k, l, last, coalesce(lag(last) OVER (PARTITION BY doc_id, k ORDER BY last), 0) + 1 AS first
      FROM (SELECT doc_id, k, l, unnest(ends) AS last FROM e)),
s AS (SELECT doc_id, k, first, last, true AS chunk, array_to_string(l[first : last], chr(10)) AS bytes FROM c WHERE last > first
      UNION ALL
      SELECT doc_id, k, first, first + 1, false, l[first] || chr(10) || l[first + 1]
      FROM (SELECT doc_id, k, l, unnest(range(1, n)) AS first FROM e)),
later AS (SELECT doc_id, k, first, last, chunk
          FROM (SELECT *, row_number() OVER (PARTITION BY chunk, bytes ORDER BY doc_id NULLS FIRST, k, first) AS place FROM s)
          WHERE place > 1),
o AS (SELECT *, NOT chunk AND coalesce(first > max(last) FILTER (NOT chunk) OVER (
                  PARTITION BY doc_id, k ORDER BY first, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
      FROM later),
g AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id, k ORDER BY first, chunk ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT doc_id, k, run, min(first) FILTER (NOT chunk) AS first, max(last) FILTER (NOT chunk) AS last
      FROM g GROUP BY ALL HAVING bool_or(chunk) OR max(last) FILTER (NOT chunk) - min(first) FILTER (NOT chunk) >= 2),
d AS (SELECT doc_id, k, count(*) AS runs, flatten(list(range(first, last + 1))) AS gone FROM u GROUP BY ALL)
SELECT x.doc_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(e.ends), 0) AS BIGINT) AS n_chunks,
       CAST(coalesce(d.runs, 0) AS BIGINT) AS n_removed_runs, CAST(coalesce(len(d.gone), 0) AS BIGINT) AS n_removed_lines,
       CASE WHEN d.gone IS NULL THEN sha256(x.text)
            ELSE sha256(array_to_string(list_transform(
              list_filter(range(1, e.n + 1), lambda i: NOT list_contains(d.gone, i)), lambda i: e.l[i]), chr(10))) END AS kept_sha256
FROM documents x LEFT JOIN e ON e.doc_id IS NOT DISTINCT FROM x.doc_id AND e.k = md5(x.text)
LEFT JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.k = md5(x.text)""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated passages of lines."""
    from tidemark.llm.line_chunks import line_report

    found = line_report(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_chunks", "n_removed_runs", "n_removed_lines",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op3_near_classes")
def near_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document; the smallest id of a class is kept."""
    from tidemark.llm.near_dedup import near_classes

    found = near_classes(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@_query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    packed = pack_documents(_table(spark, sf_dir, "documents"), "doc_id", "text",
                            public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


@_query("op9_pii_spans")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from tidemark.llm.pii import detect_pii, fit_trees

    docs = _table(spark, sf_dir, "documents")
    return detect_pii(docs, "doc_id", "text", fit_trees(docs, "text")).withColumnRenamed("id", "doc_id")


@_query("op5_warc_round_trip")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by boundary chains."""
    from tidemark.llm.warc import archive_round_trip, page_of

    read = archive_round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read.select(
        page_of(F.col("record_id")).cast("long").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        page_of(F.col("refers_to")).cast("long").alias("refers_to"))


@_query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    import public_tokenizers

    from tidemark.llm.byte_bpe import encode_digests, load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_digests(_table(spark, sf_dir, "documents"), "doc_id", "text", ranks,
                          public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@_query("op6_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 200 bytes that also start elsewhere."""
    from tidemark.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text", digest=True) \
        .withColumnRenamed("id", "doc_id")


@_query("op1_exact_top_k", r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    from tidemark.llm.metric_search import scaled, top_products, usable

    vectors = _table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    rows = vectors.select(F.col("vec_id").alias("id"), scaled(F.col("embedding")).alias("v"))
    return top_products(rows, 5, F.col("id") % 50 == 0)


@_query("op4_vector_links")
def vector_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors of each label at a cosine of 0.98."""
    from tidemark.llm.embedding_dedup import vector_links

    return vector_links(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label") \
        .withColumnRenamed("id", "vec_id")


@_query("op11_ranked_search", r"""
WITH t AS (SELECT rid, doc_id, term, count(*) AS tf
           FROM (SELECT row_number() OVER () AS rid, doc_id,
                        unnest(regexp_extract_all(
                            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                 FROM documents)
           GROUP BY ALL),
d AS (SELECT rid, doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY ALL),
c AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM t, c GROUP BY term, documents),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * n * documents) // terms) AS m FROM d, c),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
s AS (SELECT i.item_id, i.text, t.rid, t.doc_id,
             CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
      FROM i JOIN t ON i.term = t.term JOIN w ON w.term = t.term JOIN m ON m.rid = t.rid
      GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s)
WHERE rank <= 50""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    from tidemark.llm.lexical_search import ranked_documents

    return ranked_documents(_table(spark, sf_dir, "documents"), "doc_id", "text",
                            _table(spark, sf_dir, "benchmark"), "item_id", "text", 50)


@_query("op12_spelling_variants", r"""
WITH RECURSIVE
-- the CRC of each byte value, eight steps each
b AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS step FROM range(256) t(i)
      UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, step + 1 FROM b WHERE step < 8),
crc AS MATERIALIZED (SELECT i, c FROM b WHERE step = 8),
o AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
k AS MATERIALIZED (SELECT row_number() OVER () AS rid, run, times,
                          hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM o),
h AS (SELECT rid, 4294967295::UBIGINT AS c, bytes AS left_over FROM k
      UNION ALL
      SELECT h.rid, xor(h.c >> 8, crc.c), substr(h.left_over, 3)
      FROM h JOIN crc ON crc.i = xor(h.c & 255, ('0x' || substr(h.left_over, 1, 2))::UBIGINT)
      WHERE h.left_over <> ''),
x AS (SELECT rid, xor(c, 4294967295::UBIGINT)::BIGINT AS h FROM h WHERE left_over = ''),
w AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                    ELSE run END AS word, times FROM k JOIN x USING (rid))
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
-- what is left of a word without one letter
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                   FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, c.word AS near, c.n AS near_n FROM v a JOIN v c ON a.i = c.i AND a.rest = c.rest AND a.word <> c.word
    UNION ALL SELECT a.word, a.n, w.word, w.n FROM v a JOIN w ON a.rest = w.word
    UNION ALL SELECT w.word, w.n, a.word, a.n FROM v a JOIN w ON a.rest = w.word)),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p) q
    ON w.word = q.word AND q.place = 1),
r AS (SELECT word, word AS root FROM f
      UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM f JOIN r ON f.word = r.word
WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.word = r.root AND g.form IS NOT NULL)""")
def spelling_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    from tidemark.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("op13_source_mix", r"""
WITH q AS (SELECT doc_id, avg(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, md5(d.text) AS mark,
             CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CASE WHEN q.doc_id IS NULL THEN 1 WHEN q.quality IS NULL THEN 2 WHEN q.quality >= 0.5 THEN 4 ELSE 1 END AS weight,
             (('0x' || substr(md5('0|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' ||
                                  coalesce(md5(d.text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / (2.0::DOUBLE ^ 52) AS u
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
      FROM d GROUP BY source),
-- the sources with the least words for their weight stop first
o AS (SELECT *, row_number() OVER w AS k,
             sum(3 * source_size) OVER w AS stopped, sum(weight) OVER w AS gone,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(max(k) FILTER (WHERE 3 * source_size * (weights - gone + weight)
                                           < weight * (total - stopped + 3 * source_size)), 0) AS n FROM o),
a AS (SELECT (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (WHERE k <= n), 0) AS words,
             sum(weight) FILTER (WHERE k > n) AS weights FROM o, l),
t AS (SELECT source, source_size,
             CASE WHEN k <= n THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST(weight * words AS DOUBLE) / CAST(a.weights AS DOUBLE) END AS target,
             CASE WHEN k <= n THEN 3 * source_size ELSE (weight * words) // a.weights END AS budget
      FROM o, l, a),
b AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.mark
                               ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken
FROM r""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of the sources; better labelled documents are likelier."""
    from tidemark.llm.mixing import mix_sources

    rated = F.avg("quality")
    quality = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(
        F.when(rated >= 0.5, 4.0).when(rated < 0.5, 1.0).otherwise(2.0).alias("weight"))
    mixed = mix_sources(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", quality)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
