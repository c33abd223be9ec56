"""From raw documents to packed training sequences.

Five stages, each over all rows its predecessor kept: language identification
drops documents without an identifiable language; repeated passages of lines
go from the texts; one document of each group of near copies stays; personal
data is replaced by its kind; the documents are packed into sequences of 4096
tokens. Every stage's result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``, with
``n_chars`` following the text.

Defined results: documents whose text is null or has no letter go in the
first stage; a document that loses all its lines stays, with an empty text.
Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Least score of a document's language.
LEAST_SCORE = 0.2

#: No SQL: the stages learn models, hash shingles and tokenize.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import fit_language_model, held_out, keep_identified

    model = fit_language_model(docs.filter(~held_out("doc_id")))
    return keep_identified(docs, model, "text", LEAST_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_chunks import dedup_line_chunks

    return _counted(dedup_line_chunks(docs, "doc_id", "text"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import drop_near_copies

    return drop_near_copies(docs, "doc_id", "text")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import fit_trees, redact_pii

    return _counted(redact_pii(docs, "text", fit_trees(docs, "text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    return pack_documents(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")) \
        .withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_stage),
    ("line_chunks", line_stage),
    ("near_copies", near_copy_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
