"""Training corpus from documents: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them one after another.
Stages but the last return the columns of documents, whatever these are and whatever their names. A
stage judges each row by its text and doc_id, of any length; rows with a null text are judged as empty
texts, rows with a null doc_id by their text alone, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.llm import decontaminate, minhash, packing, quality_model, secret_crf
from graphwarden.llm.queries import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from all labelled documents of sf_dir. A score at the threshold is kept, and a repeated row is judged as each of its kind."""
    model = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return kept_columns(docs, lambda rows, columns: quality_model.score(rows, model, keep=columns).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group linked by sets of five-word shingles with a similarity of 0.8 or more.

    Of rows with one doc_id and one text one stays; texts of one doc_id that differ stay beside each
    other. Documents without words, and rows without a doc_id, are in no group.
    """
    found = minhash.near_duplicates(docs, size=5, numerator=80, bands=minhash.WIDE_BANDS, rows=minhash.WIDE_ROWS)
    gone = found.where("NOT kept").select("doc_id").distinct()
    rows = docs
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        names = [f"__c{i}" for i in range(len(docs.columns))]
        own, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
        # a row without a doc_id is like no other
        alike = docs.toDF(*names).withColumn("__d", F.coalesce(own.cast("string"), F.concat(F.lit("row "), F.uuid()))).withColumn("__t", F.sha2(F.coalesce(F.concat(F.lit("t"), text.cast("string")), F.lit("")), 256))
        rows = alike.dropDuplicates(["__d", "__t"]).select(*names).toDF(*docs.columns)
    return rows.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark; repeated rows are judged one by one, and without a benchmark all stay."""
    benchmark = table(spark, sf_dir, "benchmark")
    return kept_columns(docs, lambda rows, columns: decontaminate.leaks(rows, benchmark, columns).where(~decontaminate.contaminated()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; of spans that overlap the first is replaced whole, and null texts stay null."""
    return secret_crf.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; repeated rows are packed as documents of their own, and long ones are cut."""
    return packing.pack(docs)


def kept_columns(docs: DataFrame, judge) -> DataFrame:
    """judge(rows, columns) with the columns of docs under names that clash with none of its own, named back after it."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    return judge(rows, names).select(*names).toDF(*docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", pack)]

#: The field, the trees and the tokenizer cannot be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
