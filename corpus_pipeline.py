"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``docs``.  ``run`` writes each stage's result
to the shared folder and reads it again, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.llm import personal_data
from docquarry.llm.common import fresh, table
from docquarry.llm.exact_dedup import drop_copies
from docquarry.llm.jaccard_join import near_copies, text_key
from docquarry.llm.packing import best_fit_pack
from docquarry.llm.quality import quality_scores
from docquarry.session import cut_lineage

#: No SQL: the classifier, the contexts and the tokenizer can't be said in it.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.  Rows that share an id share a fate:
    they stay if one of them would."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    rejected = scores.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0")
    rejected = cut_lineage(rejected.select(F.col("doc_id").alias("__gone")), "rejected")
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of smallest id (null last), of each class of near duplicates.

    Rows are known by id and text, so unlike texts under one id, or without an id, don't share a
    fate; of rows that repeat the id and the text that a class keeps, one stays.
    """
    key = fresh(docs, "__text_key")
    keyed = docs.withColumn(key, text_key("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__of")) & (F.col(key) == F.col("__of_key"))
    members = cut_lineage(near_copies(docs).select(F.col("doc_id").alias("__of"), F.col("text_key").alias("__of_key"), "kept"), "near-copies")
    kept = members.filter("kept").select("__of", "__of_key")
    # By sorting at any size: the dropped rows grow with the corpus and are never broadcast.
    stay = keyed.hint("merge").join(members.filter("not kept").select("__of", "__of_key"), same, "left_anti")
    ids = stay.select("doc_id", key).join(kept, same, "left_semi")
    repeated = cut_lineage(
        ids.groupBy(F.col("doc_id").cast("long").alias("__of"), F.col(key).alias("__of_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "near-repeats",
    )
    if not repeated.isEmpty():
        once = stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key])
        stay = stay.join(repeated, same, "left_anti").unionByName(once)
    return stay.drop(key)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents; personal data in their texts is replaced by its kind in brackets."""
    return personal_data.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, with their sequence and place in it."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
