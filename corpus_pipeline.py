"""A corpus from raw documents to a mix: STAGES, applied one after the other.

The stages pass documents on with the columns of DOCUMENT_COLUMNS; the last gives the documents that the mix takes, with how many words
it takes of each. Null ids, repeated ids and repeated rows are documents like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm import decontamination, jaccard_join, mixing, quality_knn, secrets

#: SQL can't express the classifier, nor the stages after it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality_knn.fit(docs, C.read(spark, sf_dir, "labels"))
    return quality_knn.keep_quality(docs.select(*C.DOCUMENT_COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id (null ids last), then the smallest hash of id and text, then the first by
    its other columns. Different texts under one id are different documents. Texts without words are linked with nothing and stay."""
    docs = docs.select(*C.DOCUMENT_COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    linked = jaccard_join.jaccard_components(docs, id_col="row_key").where("n_shingles > 0")
    linked = linked.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component"))
    sizes = linked.groupBy("row_key", "component").agg(F.count("*").alias("n"))
    ids = docs.select("row_key", "doc_id").distinct()
    sizes = C.checkpoint(sizes.join(ids, "row_key"))
    stays = sizes.groupBy("component").agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("stays"))
    dropped = sizes.join(stays, "component").where("row_key <> stays").select("row_key")
    return C.without_keys(docs, "row_key", C.checkpoint(dropped), sizes.where("n > 1").select("row_key")).drop("row_key")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs.select(*C.DOCUMENT_COLUMNS), C.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact_secrets(docs.select(*C.DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken. Rows of equal id, text and source (texts without words
    aside, which the mix never takes) are one row, the first by its other columns, that takes their sum."""
    docs = docs.select(*C.DOCUMENT_COLUMNS)
    sums = [F.min(c).alias(c) for c in ("size", "source_size", "target")]
    taken = mixing.mix(docs).where("taken > 0").groupBy("key").agg(*sums, F.sum("taken").alias("taken"))
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text", "source")).join(taken, "key")
    rest = F.struct("lang", "n_chars")
    first = keyed.groupBy("key").agg(F.min(rest).alias("rest"), *[F.first(c).alias(c) for c in ("doc_id", "text", "source", "size", "source_size", "target", "taken")])
    return first.select("doc_id", "text", "rest.lang", "source", "rest.n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secret_scan),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = C.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
