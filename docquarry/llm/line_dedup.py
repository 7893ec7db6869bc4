"""Lines that other documents hold already (DataFrame operations only).

Lines become hashes of their keys, which are range-partitioned and sorted by document and
position.  A pass over each range sees the first document of every key; the lines of all later
documents are dropped.  What travels is a few numbers a line, and back come bitmaps a document:
64 lines a word, of which only words with a dropped line are stored.

A key is known by 96 bits of hash.  Keys that a sixteenth of all lines shows to be frequent are
dealt over as many ranges as their share asks for; each range finds its own first document, and
the firsts of a key are compared once more.  The sample decides where rows go, never what is kept.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docquarry.llm.common import shuffle_parts
from docquarry.llm.exact_dedup import WHITE
from docquarry.operators.steps import let
from docquarry.session import compute_once, cut_lineage

#: Code points that a key must have for its lines to be compared.
LEAST_POINTS = 10
#: One line in so many is counted to find frequent keys.
SHARE = 16
#: A key with fewer counted lines is never dealt out.
LEAST_HOT = 32


def line_key(line: Column) -> Column:
    """The line without white space (9 to 13, 32) at its ends, A-Z in lower case."""
    body = F.trim(line, F.lit(WHITE))
    plain = F.char_length(body) == F.octet_length(body)
    return F.when(plain, F.lower(body)).otherwise(F.translate(body, ascii_uppercase, ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _row_mark(text: Column) -> Column:
    """Tells unlike texts under one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, tail, doc, mark, place) of every line that is long enough."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), t.alias("text"), _row_mark(t).alias("mark"))
    # Else Catalyst moves the hash of the whole text behind the generator, once a line.
    rows = compute_once(rows, "mark")
    # Keys are made inside the array, so that the filter and both hashes read them made.
    keys = F.transform(lines_of(F.col("text")), line_key)
    lines = rows.select("doc", "mark", F.posexplode(keys).alias("place", "line"))
    body = F.col("line")
    return lines.where(F.char_length(body) >= LEAST_POINTS).select(
        F.xxhash64(body).alias("key"), F.hash(body).alias("tail"), "doc", "mark", "place"
    )


def _frequent(lines: DataFrame) -> DataFrame:
    """(key, tail, salts) of keys with more than an eighth of a partition's lines: at most 8 a partition."""
    parts = shuffle_parts(lines.sparkSession)
    sample = lines.where(F.pmod(F.xxhash64("key", "doc", "mark", "place"), F.lit(SHARE)) == 0)
    counts = cut_lineage(sample.groupBy("key", "tail").agg(F.count(F.lit(1)).alias("n")), "line-sample")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fair = max(LEAST_HOT, total / (8 * parts))
    return counts.where(F.col("n") > fair).select("key", "tail", F.ceil(F.col("n") / fair).cast("int").alias("salts"))


def line_keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document that loses lines: ``doc``, ``mark`` (hash of its text), ``keep``, ``n_dropped``.

    ``keep`` holds words of 64 lines in order, as (``word``, ``bits``); a set bit is a line that
    stays, and of words that aren't listed all lines stay.
    """
    lines = _keys(docs, doc_id, text)
    dealt = (
        lines.join(F.broadcast(_frequent(lines)), ["key", "tail"], "left")  # at most 8 rows a partition
        .withColumn(
            "salt",
            # Copies of one row must part as well, so the task that read the row counts too.
            F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc", "mark", "place", F.spark_partition_id()), F.col("salts")))
            .otherwise(F.lit(-1)).cast("int"),
        )
        .drop("salts")
        .repartitionByRange("key", "tail", "salt")
    )
    in_order = W.partitionBy("key", "tail", "salt").orderBy(F.col("doc").asc_nulls_last(), "mark", "place")
    streamed = dealt.withColumn("later", ~F.col("doc").eqNullSafe(F.first("doc").over(in_order)))
    # Kept: what is dropped already, and the first lines of each range of a frequent key.
    open_lines = cut_lineage(streamed.where("later or salt >= 0"), "line-firsts")
    heads = open_lines.where("salt >= 0 and not later")
    firsts = heads.groupBy("key", "tail").agg(F.min("doc").alias("first"))  # a row a frequent key
    beaten = heads.join(F.broadcast(firsts), ["key", "tail"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    dropped = open_lines.where("later").select("doc", "mark", "place").unionByName(beaten.select("doc", "mark", "place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    words = dropped.groupBy("doc", "mark", F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))
    return words.groupBy("doc", "mark").agg(packed.alias("keep"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def keep_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set in ``keep``; ``keep`` must be a stored column."""
    before = lambda i: F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1))
    whole = F.lit(-1).cast("long")
    words = F.flatten(F.transform(keep, lambda w, i: F.concat(F.array_repeat(whole, w["word"] - before(i) - 1), F.array(w["bits"]))))
    return let(words, lambda w: F.filter(lines, lambda x, i: F.bit_get(F.coalesce(F.get(w, F.shiftright(i, 6)), whole), i % 64) == 1))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line's key is the line without white space at its ends, A-Z in lower case.  Keys of ten or
    more code points that stand in two or more documents lose their lines in all but the one of
    smallest id, where all of them stay, also repeated ones.  Rows that share an id count as one
    document and keep the line together; rows without an id count as one document, the last.
    A null text is one empty line, as an empty one is.  An empty table gives an empty result;
    further columns are ignored.
    """
    kept = cut_lineage(line_keep_bitmaps(docs, doc_id, text), "line-bitmaps")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), t.alias("__text"), _row_mark(t).alias("__mark"))
    joined = rows.join(kept, F.col("__id").eqNullSafe(F.col("doc")) & (F.col("__mark") == F.col("mark")), "left")
    return joined.select(
        F.col("__id").alias(doc_id),
        F.size(lines_of(F.col("__text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("__text")).otherwise(F.concat_ws("\n", keep_lines(lines_of(F.col("__text")), F.col("keep")))).alias("kept_text"),
    )
