"""Exact duplicates by content sort (DataFrame operations only).

Rows are range-partitioned by sampled splitters of their normalised bytes, sorted externally
and compared in full with their neighbours.  The splitters use a bounded prefix and a 64-bit
hash of the normalised text (the sample that reaches the driver is then a few bytes a row);
the sort and the comparison use the whole text.

Texts that hold a large share of the rows are dealt over as many ranges as their share asks for:
each range keeps one head, and the few heads are compared once more.  There are at most ``8 *
partitions`` such texts, since each has more than an eighth of a partition's rows, and at most
twice as many ranges of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docquarry.llm.common import shuffle_parts
from docquarry.session import cut_lineage

#: A text with fewer copies is never dealt out.
LEAST_HOT = 32
WHITE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """The text without the characters 9 to 13 and 32 (null: empty)."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    kept_only: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id``, the ``carry`` columns, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the row with the most code points stays, then the smallest id
    (a null id comes last), then any one of rows that are alike.  Null texts count as empty
    and form one group with texts of white space.  An empty table gives an empty result.
    ``kept_only`` returns the rows that stay; ``with_text`` adds ``text`` (null: empty).
    """
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(
        d.alias("__id"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.coalesce(t.cast("string"), F.lit("")).alias("__text")
    )
    body = normalised(F.col("__text"))
    counts = rows.groupBy(F.xxhash64(body).alias("__hash")).agg(F.count(F.lit(1)).alias("__n"))
    total = docs.count()
    fair = max(LEAST_HOT, total // (8 * parts))
    hot = counts.filter(F.col("__n") > fair).select("__hash", F.ceil(F.col("__n") / fair).cast("int").alias("__salts"))
    dealt = (
        rows.withColumn("__hash", F.xxhash64(body))
        .withColumn("__prefix", F.substring(body, 1, 12))
        .join(F.broadcast(hot), "__hash", "left")  # at most 8 * parts rows
        .withColumn(
            "__salt",
            F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64("__id", "__text"), F.col("__salts"))).otherwise(F.lit(-1)).cast("int"),
        )
        .drop("__salts")
        .repartitionByRange("__prefix", "__hash", "__salt")
    )
    # Equal texts now stand in one range; the sort brings them together, and the window
    # tells its groups apart by comparing the whole text of each row with the one before.
    group = W.partitionBy("__prefix", "__hash", "__salt", "__body")
    best = group.orderBy(F.col("__size").desc(), F.col("__id").asc_nulls_last())
    ranked = (
        dealt.withColumn("__body", normalised(F.col("__text")))
        .withColumn("__size", F.char_length("__text"))
        .withColumn("text_sha256", F.sha2(F.col("__body").cast("binary"), 256))
        .withColumn("__rank", F.row_number().over(best))
        .withColumn("__keep", F.first("__id").over(best))
        .withColumn("__most", F.first("__size").over(best))
    )
    carried = [*[f"__c{i}" for i in range(len(carry))], *(["__text"] if with_text else [])]
    sizes = ranked.withColumn("group_size", F.count(F.lit(1)).over(group))
    slim = sizes.select("__id", *carried, "text_sha256", "__hash", "__salt", "__rank", "__keep", "__most", "group_size")
    slim = cut_lineage(slim.filter("__rank = 1") if kept_only else slim, "exact-dedup")
    heads = slim.filter((F.col("__rank") == 1) & (F.col("__salt") >= 0))
    whole = W.partitionBy("text_sha256")
    first = whole.orderBy(F.col("__most").desc(), F.col("__keep").asc_nulls_last(), "__salt")
    joined = heads.select(  # at most 16 rows a partition
        "text_sha256",
        "__salt",
        F.first("__keep").over(first).alias("__all_keep"),
        (F.row_number().over(first) == 1).alias("__all_first"),
        F.sum("group_size").over(whole).alias("__all_size"),
    )
    out = slim.join(F.broadcast(joined), ["text_sha256", "__salt"], "left")
    return out.select(
        F.col("__id").alias(doc_id),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        *([F.col("__text").alias(text)] if with_text else []),
        F.when(F.col("__salt") >= 0, F.col("__all_keep")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__all_size", "group_size").alias("group_size"),
        ((F.col("__rank") == 1) & F.coalesce("__all_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their own columns.

    A text travels once, as the column that is compared; a flag tells null from empty.
    """
    others = {c: f"__d{i}" for i, c in enumerate(docs.columns) if c != text}
    plain = docs.select(  # columns may repeat the operator's names
        F.col(f"`{doc_id}`").alias("__row_id"), F.col(f"`{text}`").alias("__row_text"), F.col(f"`{text}`").isNull().alias("__no_text"),
        *[F.col(f"`{c}`").alias(n) for c, n in others.items()],
    )
    kept = exact_dedup(plain, "__row_id", "__row_text", ("__no_text", *others.values()), kept_only=True, with_text=True).filter("kept")
    body = F.when(~F.col("__no_text"), F.col("__row_text"))
    return kept.select(*[body.alias(c) if c == text else F.col(others[c]).alias(c) for c in docs.columns])
