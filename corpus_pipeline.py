"""From raw documents to packed training windows, in five stages over whole tables.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again before the next. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltable.llm import crf, minhash, mixing, packing, secrets
from moltable.llm.queries import KEEP_SCORE, PACK_END, vocabulary
from moltable.runtime import stage

NEAR = 0.8


def _row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, which no column that an operator adds can clash with."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on these documents' labels, does not reject.

    A null or empty text is scored as one empty line. Repeated rows share one fate; a null id is scored like
    any other. All columns, of whatever names, return as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = docs.select(_row(docs), "text")
    scored = crf.score_documents(given, crf.train(docs, labels), ["row"])
    return scored.where(F.col("quality") >= KEEP_SCORE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows that share an id are one document and stay or go together. Texts that are null or blank, and rows without an id,
    are linked with nothing and stay. All columns return as they were.
    """
    found = minhash.near_duplicates(docs, NEAR)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row(docs))
    return given.join(gone, "doc_id", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows where a text has changed.

    A null text stays null, an empty one empty. Repeated rows are scanned each. All other columns return as they were.
    """
    found = secrets.with_secrets(docs.select(_row(docs), "text"), secrets.discovery_limits(docs))
    clean = secrets.redacted(F.col("text"), F.col("secret_spans"))
    length = F.when(F.size("secret_spans") > 0, F.length("clean")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("clean"), "n_chars": length.cast(docs.schema["n_chars"].dataType)}
    out = [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return found.withColumn("clean", clean).select(*out)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words weigh nothing and are never taken; null sources are one source. Rows equal in id and text share
    one decision. All columns return as they were.
    """
    mixed = mixing.mix_sources(docs.select(_row(docs), "doc_id", "text", "source")).where("mix.copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of several lengths: the rows of ``packing.pack_documents``.

    A null or empty text is its end id alone; repeated rows are packed each; a null id stays null.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), PACK_END)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix),
    ("packing", pack),
]

#: Models, hashes and tokenizers have no SQL form; tests compare the stages with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
