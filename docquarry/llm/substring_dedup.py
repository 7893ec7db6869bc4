"""Repeated passages by a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of k words, joining its first and its last k - 1 words.  Each
edge has an anchor, the shorter m-mer of least hash inside it; the edges of a text that follow
each other under one anchor travel as one row (a path segment with its source coordinates), so
one shuffle by anchor brings all equal edges together at a few bytes an edge.  There, repeated
edges that follow each other in the source compact into one path.  Paths of one document are
put end to end by a join on the document, and the coordinates lead back to its words.

Equal edges have equal anchors, at places of their own, so a segment whose anchor occurs once
holds no repeated edge.  Anchors are counted first, and segments of single ones aren't shuffled:
a Bloom filter of the others, at most 64 MB, tells.  Where it errs, or is full, more segments
travel than need be, and none is lost.

An edge is known by 96 bits of two hashes of its words, besides its anchor, so that under one
hot anchor, which tells nothing apart, unlike edges still don't meet: of the 6e9 edges of some
30 GB, all under one anchor, 2e19 pairs at 2**-96 each.  Frequent anchors are dealt over
``SALTS`` groups; edges that are alone in their group are compared once more between groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from docquarry.llm.common import group_ids, mix, shuffle_parts, slices, whole_groups, window_hashes, word_hashes
from docquarry.session import cut_lineage

#: Words of an anchor.
ANCHOR = 8
SALTS = 64
#: An anchor with fewer path segments is never dealt out.
LEAST_HOT = 2000
#: Bits of a filter for each anchor that occurs more than once, of one of its pieces, and most pieces.
ANCHOR_BITS = 8
PIECE_BITS = 20
MOST_PIECES = 512
_WIDTH = 16  # bytes of an edge's two hashes
_SENT = 12  # of these, bytes that travel: the first hash and the low half of the second
_OTHER = np.uint64(0xA0761D6478BD642F)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost on ties."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while have * 2 <= width:
        left, right = at[:-have], at[have:]
        at = np.where(values[right] < values[left], right, left)
        have *= 2
    if width > have:
        left, right = at[:n], at[width - have : width - have + n]
        at = np.where(values[right] < values[left], right, left)
    return at[:n]


def segments(texts: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, first edge and packed edge hashes (with offsets) of each path segment."""
    words, counts = word_hashes(texts)
    anchor = min(ANCHOR, k)
    if len(words) < k:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    least = window_hashes(words, anchor)
    place = sliding_argmin(least, k - anchor + 1)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[: len(place)]
    edges = np.flatnonzero(np.arange(len(place)) + k <= ends[text])
    new = np.ones(len(edges), bool)
    new[1:] = (np.diff(edges) != 1) | (text[edges[1:]] != text[edges[:-1]]) | (place[edges[1:]] != place[edges[:-1]])
    first = edges[new]
    packed = np.column_stack([window_hashes(words, k)[edges], window_hashes(mix(words ^ _OTHER), k)[edges]]).astype("<u8")
    offsets = np.append(np.flatnonzero(new), len(edges)) * _WIDTH
    begin = ends - counts
    return text[first], least[place[first]].view(np.int64), first - begin[text[first]], np.ascontiguousarray(packed).view(np.uint8).ravel(), offsets


def sent_edges(packed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed edge hashes that travel, with their offsets."""
    return np.ascontiguousarray(packed.reshape(-1, _WIDTH)[:, :_SENT]).ravel(), offsets // _WIDTH * _SENT


def read_edges(sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second hash of edges that travelled."""
    rows = sent.reshape(-1, _SENT)
    return np.ascontiguousarray(rows[:, :8]).view("<u8").ravel(), np.ascontiguousarray(rows[:, 8:]).view("<u4").ravel().astype(np.uint64)


def equal_edges(group: np.ndarray, edge: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each distinct edge, the number of each place's edge, and how often it occurs."""
    order = np.lexsort((other, edge, group))
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in (group, edge, other):
        new[1:] |= np.diff(c[order]) != 0
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back, np.bincount(back)


def _filter_places(pieces: int) -> tuple[Column, list[Column]]:
    """Piece of the filter that tells of ``anchor``, and its two bits there."""
    mixed = F.xxhash64("anchor")
    bits = [F.shiftrightunsigned(mixed, by).bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).cast("int") for by in (20, 40)]
    return F.pmod(mixed, F.lit(pieces)).cast("int"), bits


def anchor_filter(anchors: DataFrame, pieces: int) -> DataFrame:
    """(piece, bits): a Bloom filter of the column ``anchor``; pieces without anchors are left out."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            piece = batch.column("piece").to_numpy()
            for one in np.unique(piece):
                words = found.setdefault(int(one), np.zeros(1 << PIECE_BITS - 6, np.uint64))
                for name in ("a", "b"):
                    bit = batch.column(name).to_numpy()[piece == one]
                    np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        for one, words in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([one], pa.int32()), pa.array([words.view(np.int64)], pa.list_(pa.int64()))], ["piece", "bits"]
            )

    piece, (a, b) = _filter_places(pieces)
    return anchors.select(piece.alias("piece"), a.alias("a"), b.alias("b")).repartition("piece").mapInArrow(fill, "piece int, bits array<long>")


def maybe_among(rows: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """All rows whose ``anchor`` is one of the ``n`` anchors, and a few per cent of the others."""
    pieces = min(MOST_PIECES, max(1, -(-n * ANCHOR_BITS >> PIECE_BITS)))
    piece, bits = _filter_places(pieces)
    known = anchor_filter(anchors, pieces)
    same = piece == F.col("piece")
    for bit in bits:
        same &= F.getbit(F.get("bits", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1
    return rows.join(F.broadcast(known), same, "left_semi")


def repeated_spans(docs: DataFrame, k: int) -> DataFrame:
    """(__id, __key, start, stop) in words: all paths of edges that start anywhere else too.

    ``docs``: __id, __key (a hash of the text) and __text.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([pa.array(segments(part.column("__text"), k)[1])], ["anchor"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                text, anchor, first, packed, offsets = segments(part.column("__text"), k)
                packed, offsets = sent_edges(packed, offsets)
                edges = pa.Array.from_buffers(
                    pa.binary(), len(text), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)]
                )
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), part.column("__id").take(of), part.column("__key").take(of), pa.array(first.astype(np.int32)), edges],
                    ["anchor", "__id", "__key", "first", "edges"],
                )

    seen = Observation("anchors")
    counts = docs.select("__text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.observe(seen, F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("shared"))
    counts = cut_lineage(counts.filter(F.col("n") > 1), "anchor-counts")
    share = (seen.get["total"] or 0) // (8 * shuffle_parts(docs.sparkSession))
    hot = counts.filter((F.col("n") > LEAST_HOT) & (F.col("n") > share)).select("anchor", F.lit(True).alias("hot"))  # at most 8 * partitions rows
    dealt = (
        maybe_among(docs.mapInArrow(split, "anchor long, __id long, __key long, first int, edges binary"), counts, seen.get["shared"])
        .join(F.broadcast(hot), "anchor", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("__id", "__key", "first"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int"))
        .drop("hot")
        .repartition("anchor", "salt")
        .sortWithinPartitions("anchor", "salt")
    )

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("anchor", "salt")):
            rows = rows.combine_chunks()
            anchor, salt = rows.column("anchor").to_numpy(), rows.column("salt").to_numpy()
            group = group_ids(anchor, salt)
            use = np.flatnonzero((salt >= 0) | (np.bincount(group)[group] > 1))
            if not len(use):
                continue
            rows, anchor, salt, group = rows.take(pa.array(use)), anchor[use], salt[use], group[use]
            edges = rows.column("edges").combine_chunks()
            edges = edges.chunk(0) if isinstance(edges, pa.ChunkedArray) else edges
            _, offsets, data = edges.buffers()
            cuts = np.frombuffer(offsets, np.int32)[edges.offset : edges.offset + len(edges) + 1].astype(np.int64)
            many = np.diff(cuts) // _SENT
            edge, other = read_edges(np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]])
            row = np.repeat(np.arange(len(many)), many)
            step = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many)
            index, back, n = equal_edges(group[row], edge, other)
            hit = np.flatnonzero(n[back] > 1)
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
            head = hit[new]
            tail = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
            lone = index[salt[row[index]] >= 0]
            of = np.concatenate([row[head], row[lone]])
            first = rows.column("first").to_numpy()[of]
            start = first + np.concatenate([step[head], step[lone]])
            span = np.arange(len(of)) < len(head)
            size = np.concatenate([step[tail] - step[head], np.zeros(len(lone), np.int64)]) + k
            take = pa.array(of)
            columns = [
                rows.column("__id").combine_chunks().take(take),
                rows.column("__key").combine_chunks().take(take),
                pa.array(start.astype(np.int32)),
                pa.array((start + size).astype(np.int32)),
                pa.array(anchor[of], mask=span),
                pa.array(np.concatenate([np.zeros(len(head), np.uint64), edge[lone]]).view(np.int64), mask=span),
                pa.array(np.concatenate([np.zeros(len(head), np.uint64), other[lone]]).view(np.int64), mask=span),
                pa.array(np.concatenate([np.zeros(len(head), np.int64), n[back[lone]]]), mask=span),
            ]
            yield from pa.Table.from_arrays(columns, ["__id", "__key", "start", "stop", "anchor", "edge", "other", "n"]).combine_chunks().to_batches()

    found = cut_lineage(
        dealt.mapInArrow(compact, "__id long, __key long, start int, stop int, anchor long, edge long, other long, n long"), "paths"
    )
    # Edges of frequent anchors: one row from each group that has it, so at most SALTS rows each.
    between = (
        found.filter("anchor is not null")
        .groupBy("anchor", "edge", "other")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.collect_list(F.when(F.col("n") == 1, F.struct("__id", "__key", "start", "stop"))).alias("alone"),
        )
        .filter("groups > 1")
        .select(F.inline("alone"))
    )
    return found.filter("anchor is null").select("__id", "__key", "start", "stop").unionByName(between)


def drop_repeats(docs: DataFrame, k: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans.

    Words are runs of characters other than 9 to 13 and 32.  Every word under a window of ``k``
    words that also starts elsewhere, in this or another row, goes; ``kept_text`` has the others,
    joined by one blank; ``spans`` are the repeated paths (start and stop in words).  Null texts
    have no words, and rows that are alike are documents of their own.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")
    ).withColumn("__key", F.xxhash64("__text"))
    spans = repeated_spans(rows.select("__id", "__key", "__text"), k)
    # Rows with the same id and text have the same spans; a document has fewer spans than words.
    spans = spans.groupBy("__id", "__key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select(F.col("__id").alias("__of"), F.col("__key").alias("__of_key"), "spans")
    joined = rows.join(spans, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__of_key")), "left").select(
        "__id", "__text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                n_words, n_removed, kept, merged = [], [], [], []
                columns = (part.column(c).to_pylist() for c in ("__text", "start", "stop"))
                for body, starts, stops in zip(*columns):
                    words, out, at, paths = body.encode().split(), [], 0, []
                    for a, b in zip(starts or (), stops or ()):
                        if paths and a <= paths[-1]["stop"]:
                            paths[-1]["stop"] = max(paths[-1]["stop"], b)
                        else:
                            paths.append({"start": a, "stop": b})
                    for p in paths:
                        out += words[at : p["start"]]
                        at = p["stop"]
                    out += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(out))
                    kept.append(b" ".join(out).decode())
                    merged.append(paths)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    ],
                    ["__id", "n_words", "n_removed", "kept_text", "spans"],
                )

    out = joined.mapInArrow(cut, "__id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>")
    return out.withColumnRenamed("__id", doc_id)
