"""A corpus run: quality, line dedup, near duplicates, mixing and packing, each stage over all that the one before kept.

Counted as part of tidemark.llm.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import delete, fold, scratch, temporary_tables
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.line_spread import line_dedup
from tidemark.llm.mixing import curriculum, training_order
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import fit_quality, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the fitted classifier of stage 1 nor the token ids of stage 5; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.5 (operator 1); the model learns from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, fit_quality(docs, labels), "fm_score")
    return scored.filter("fm_score >= 0.5").select(*COLUMNS)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share (operator 8); n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (operator 6: five words, similarity 0.8).

    Rows that are alone stay, documents without words among them; of several rows with a group's
    least id, all stay.
    """
    groups = jaccard_components(docs, size=5, percent=80).filter(F.col("doc_id") != F.col("component_id"))
    return docs.join(groups.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix, in training order (operator 5); what the mix leaves out goes.

    A copy that the mix takes only in part has its text cut after the words taken.
    """
    return training_order(curriculum(docs)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def file_order(docs: DataFrame) -> Column | None:
    """The place of each row of a written table: number of its file, then place there; None for rows that no file holds."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return F.struct(part.alias("part"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens placed into sequences (operator 9), in the order of the rows: that of the files, then within them."""
    packed = pack_documents(docs, order=file_order(docs))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_spread),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; what a stage stored goes when the next one's input is written, so only the result stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        path = scratch(spark)
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
