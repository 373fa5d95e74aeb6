"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.llm import decontaminate, jaccard, line_dedup, packing, quality
from cuespark.llm.common import discard, free_name, small, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labelled ones, scores 0.5 or more."""
    scored = quality.with_score(docs, quality.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = scored.columns[-1]
    return scored.where(F.col(f"`{score}`") >= 0.5).drop(score)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before; those that lose all their text go."""
    out = line_dedup.dedup_lines(docs)
    total, gone = out.columns[-2:]
    changed = F.col(gone) > 0
    out = out.where(~(changed & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(total, gone)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id: five words, similarity 0.8.

    Rows are told apart by id and text, so an id that stands on two texts is two documents, rows
    that repeat both are copies, and rows without an id take part. Rows without words all stay.
    """
    row, mark = free_name(docs, "row"), free_name(docs, "mark")
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null or doc_id < 0").select(F.col("doc_id").alias(mark), F.lit(True).alias(row))
    unclear = stored(unclear, "unclear")
    hashed = -F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) - 1
    marked = docs.join(small(unclear), F.col("doc_id").eqNullSafe(F.col(mark)), "left").withColumn(row, F.when(F.col(row), hashed).otherwise(F.col("doc_id"))).drop(mark)
    groups = jaccard.jaccard_components(marked.select(F.col(row).alias("doc_id"), "text"), width=5, threshold=80)
    groups = stored(groups.where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")), "groups")
    shared = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component_id")
    members = groups.join(shared, "component_id").select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))
    first = marked.select("doc_id", row).join(members, row).groupBy("component_id").agg(F.min(order)["row"].alias("kept"))
    gone = small(stored(members.join(first, "component_id").where(F.col(row) != F.col("kept")).select(row), "gone"))
    left = marked.join(gone, row, "left_anti")
    again = small(stored(groups.where("n > 1").select(F.col("doc_id").alias(row)), "again"))
    copies = left.join(again, row, "left_semi").dropDuplicates([row])
    return left.join(again, row, "left_anti").unionByName(copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", unique_lines),
    ("near duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: No stage but the filters' joins has a SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the training sequences of what they keep.

    Each stage is written before the next one reads it. Columns beside the given ones are carried
    to the last stage; rows without id or text, repeated rows and ids, and an empty table take the
    defined results of the stages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            if k:
                discard(before)
    return docs
