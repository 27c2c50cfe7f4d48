"""A training-corpus pipeline over the documents table: rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from lexgrove.llm.shared import cut, fresh_path, made, sweep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose content share is high enough; the line model is trained on the labelled ones among docs. Null and blank texts
    go, null ids and repeated rows are decided by their texts, a share of exactly the limit stays, and an empty table gives none."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply(docs, model, columns=COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; documents without a group all stay.

    A document is a doc_id with its text: another text with the same doc_id is judged by itself, and of rows that repeat both (whatever
    their other columns have) the one that sorts first stays. Rows without id or without words stay as they are. An empty table gives none.
    """
    rows, found = simhash.row_groups(docs)
    marks = found.where("not kept").select("doc_id", "h", F.lit(False).alias("stays"))
    marks = cut(marks.unionByName(rows.where("n > 1").select("doc_id", "h", F.lit(True).alias("stays"))))
    src = docs.select(COLUMNS).withColumn("__h", F.xxhash64("text"))

    def among(some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("__id"), F.col("h").alias("__th")).hint("shuffle_hash")
        return src.join(some, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__h") == F.col("__th")), how)

    once = among(marks, "left_anti").select(COLUMNS)
    gone, twice = marks.where("not stays"), marks.where("stays")
    if twice.isEmpty():
        return once
    left = twice.join(gone.hint("shuffle_hash"), ["doc_id", "h"], "left_anti")
    first = among(left, "left_semi").groupBy("doc_id", "__h").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return once.unionByName(first.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; odd rows are treated as suffix_dedup.without_repeats says."""
    return suffix_dedup.without_repeats(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the documents' tokens at the target weights of their sources, as documents. From here on doc_id is a block's place in
    the mix and no id of an input document. Null ids, and null or blank texts, have no tokens; see mixing.mix for all other cases."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over the mixed blocks: doc_ids are numbers of blocks, with the range of words that a window has of each.
    Odd rows are treated as packing.pack says."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Training, hashing and random draws aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again; what a stage left there goes after the next."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, start, path)
        docs = spark.read.parquet(path)
    return docs
