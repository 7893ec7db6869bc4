"""Near duplicates by a chosen-path join over word shingles.

Texts that are equal are one node.  In each of several runs every node picks a few of its
shingles with a shared hash, at a rate of ``1 / similarity`` per set, and enters one bucket for
each: two sets as similar as asked share one bucket of a run on average, and unlike sets hardly
ever meet.  Large buckets are split again on further sampled shingles, unless that doesn't
lessen the work (all their sets are alike).  In small buckets sketches of two bits from each of
64 minima are compared pair by pair first; sets without a partner there leave.  What is left is
compared with the whole shingle sets, in blocks; a pair that several buckets hold counts in the
least of them only.  The number of runs follows from the target recall.

Shingle sets are built a second time only for the texts that are left, and those texts are not
shuffled: a bit map of fixed size, which says for a hash of the text whether it may be wanted,
goes to all tasks, and an exact join on the sets follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.llm.common import mix, slices, whole_groups, window_hashes, word_hashes
from docquarry.llm.components import connected_components
from docquarry.session import cut_lineage

SHINGLE = 5
#: Members of a bucket that is compared without being split.
SMALL = 2048
#: Large buckets that are sent to all tasks, at most (16 bytes each).
FEW_BUCKETS = 50_000
#: Rounds of splitting.
DEPTH = 2
#: Shingles picked in a split, as a multiple of the rate of a run.
SPLIT_RATE = 2.0
#: Members and shingles of one block of a large bucket.
BLOCK_ROWS = 1024
BLOCK_TOKENS = 400_000
#: Minima of a sketch, and how many of them agree at least (two bits each) for a similarity of
#: 0.8: the expected number is 54.4 with a deviation of 2.9, so 5 deviations are allowed.
MINIMA, DEVIATIONS = 64, 5.0
#: Bits of the map of wanted texts (4 MB).
MAP_BITS = 1 << 25


def runs_for(recall: float) -> int:
    """Runs in which a pair at the threshold shares a bucket with probability ``recall``.

    Shared buckets of one run are about Poisson with mean 1; a split keeps each with 1 - e**-2.
    """
    return math.ceil(-math.log(1 - recall) / (1 - math.exp(-SPLIT_RATE)) ** DEPTH)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, none if empty."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    windows = window_hashes(words, size)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            out.append(np.unique(windows[end - n : end - size + 1]))
        elif n:
            out.append(window_hashes(words[end - n : end], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pick(tokens: np.ndarray, size: np.ndarray, node: np.ndarray, rate: float) -> np.ndarray:
    """Places of the tokens that a path at ``node`` takes (the same for all sets at the node)."""
    limit = np.minimum(rate / size, 1.0) * 2.0**53
    return np.flatnonzero((mix(tokens ^ node) >> np.uint64(11)).astype(np.float64) < limit)


def child(node: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node + np.uint64(0x632BE59BD9B4E019)) ^ token).view(np.int64)


def _token_lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words per set with one bit each of MINIMA minima (sets without tokens: 0)."""
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    factors = mix(np.arange(1001, 1001 + MINIMA, dtype=np.uint64)) | np.uint64(1)
    for i, factor in enumerate(factors if len(some) else ()):
        least = mix(np.minimum.reduceat(tokens * factor, starts))
        low[some] |= (least & np.uint64(1)) << np.uint64(i)
        high[some] |= (least >> np.uint64(1) & np.uint64(1)) << np.uint64(i)
    return low, high


def agreeing(similarity: float) -> int:
    """Minima of two sketches that agree, at least, in a pair of this similarity."""
    p = similarity + (1 - similarity) / 4
    return math.floor(MINIMA * p - DEVIATIONS * math.sqrt(MINIMA * p * (1 - p)))


def prune(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (bucket, key, n) of small buckets that have a partner by size and sketch."""
    least = agreeing(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ("bucket",), 4096):
            bucket, n = part.column("bucket").to_numpy(), part.column("n").to_numpy()
            low, high = (part.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
            starts = np.append(np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]), len(bucket))
            size = np.diff(starts)
            keep = np.zeros(len(bucket), bool)
            # Most buckets hold a few sets: compare each row with the following ones, all buckets at once.
            group = np.repeat(np.arange(len(size)), size)
            for step in range(1, int(size.max()) if len(size) else 0):
                left = np.flatnonzero(group[step:] == group[:-step])
                right = left + step
                differ = low[left] ^ low[right] | high[left] ^ high[right]
                good = MINIMA - np.bitwise_count(differ) >= least
                good &= np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right])
                keep[left[good]] = keep[right[good]] = True
            if keep.any():
                yield from part.filter(pa.array(keep)).select(["bucket", "key", "n"]).combine_chunks().to_batches()

    ready = rows.select("bucket", "key", "n", "low", "high").repartition("bucket").sortWithinPartitions("bucket")
    return ready.mapInArrow(run, "bucket long, key binary, n int")


def first_buckets(docs: DataFrame, rate: float, runs: int) -> DataFrame:
    """(bucket, key, n, low, high) of all runs, for docs (__key, __text)."""
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                sets = shingle_sets(part.column("__text"))
                n = np.array([len(s) for s in sets])
                tokens = np.concatenate(sets)
                of = np.repeat(np.arange(len(sets)), n)
                size = n[of]
                owner, bucket = [], []
                for seed in seeds:
                    at = pick(tokens, size, seed, rate)
                    owner.append(of[at])
                    bucket.append(child(np.full(len(at), seed), tokens[at]))
                owner = np.concatenate(owner)
                low, high = (x.view(np.int64)[owner] for x in sketches(tokens, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(bucket)),
                        part.column("__key").take(pa.array(owner)),
                        pa.array(n[owner].astype(np.int32)),
                        pa.array(low),
                        pa.array(high),
                    ],
                    ["bucket", "key", "n", "low", "high"],
                )

    # Copies of a text pick the same buckets and become one row before the shuffle.
    return docs.mapInArrow(run, "bucket long, key binary, n int, low long, high long").distinct()


def live_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, members) of buckets of two or more, one of those that hold the same members."""
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("key")).alias("f1"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col("key"))).alias("f2"),
    )
    return sizes.filter("members > 1").groupBy("members", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket", "members")


def split(rows: DataFrame, sets: DataFrame, rate: float) -> DataFrame:
    """(parent, bucket, key, n): the children of each row's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            cuts = lists.offsets.to_numpy()
            n = np.diff(cuts)
            tokens = lists.values.to_numpy()[cuts[0] : cuts[-1]].view(np.uint64)
            of = np.repeat(np.arange(len(n)), n)
            parent = batch.column("bucket").to_numpy()
            node = parent.view(np.uint64)[of]
            at = pick(tokens, n[of], node, rate * SPLIT_RATE)
            owner = of[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parent[owner]), pa.array(child(node[at], tokens[at])), batch.column("key").take(pa.array(owner)), pa.array(n[owner].astype(np.int32))],
                ["parent", "bucket", "key", "n"],
            )

    # Sets hold a key several times where rows repeat an id and a text: a child has it once.
    return _met(rows.select("bucket", "key"), sets, "key").select("bucket", "key", "tokens").mapInArrow(run, "parent long, bucket long, key binary, n int").distinct()


def _compare(tokens: list[np.ndarray], paths: list[np.ndarray], bucket: int, side: np.ndarray | None, similarity: float) -> np.ndarray:
    """Matrix of the pairs that are as similar as asked and belong to this bucket."""
    n = len(tokens)
    sizes = np.array([len(t) for t in tokens])

    def shared(lists: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(lists)
        row = np.repeat(np.arange(n), [len(x) for x in lists])
        values, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        some = times > 1  # what one set has alone is in no intersection
        place = np.cumsum(some) - 1
        use = some[back]
        row, column = row[use], place[back[use]]
        total = np.zeros((n, n), np.float32)
        width = max(1, min(int(some.sum()), 4_000_000 // n))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(some.sum()), width):
            a, b = np.searchsorted(column, (at, at + width))
            part = np.zeros((n, width), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            total += part @ part.T
        return total

    inter = shared(tokens)
    good = inter >= similarity * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
    np.fill_diagonal(good, False)
    if side is not None:
        good &= side[:, None] != side[None, :]
    if good.any():
        good &= shared([p[p < bucket] for p in paths]) == 0
    return good


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides, whatever their sizes: the tables of a small input are joined as
    those of a large one, and no side that grows with the corpus is ever broadcast."""
    return left.hint("merge").join(right, on, how)


def links(leaves: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, other, copies): for each node the copies it is linked with, and star edges.

    A row with ``other`` is an edge that keeps linked nodes together; a row without is a sum of
    the copies of linked texts.
    """
    paths = leaves.groupBy("key").agg(F.collect_list("bucket").alias("paths"))  # a few dozen buckets each
    mass = leaves.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens_in"))
    mass = mass.select(
        "bucket",
        F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("tokens_in") / BLOCK_TOKENS)).cast("int").alias("blocks"),
    )
    mass = cut_lineage(mass, "bucket-blocks")
    own = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    placed = _met(leaves.select("bucket", "key"), mass, "bucket").withColumn("own", own)
    dealt = (
        _met(_met(placed, paths, "key"), sets, "key")  # the large side comes last, and rows are repeated for their blocks after it
        .withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "against"))
        .withColumn("high", F.greatest("own", "against"))
    )
    ready = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("bucket", "low", "high"), 2048):
            rows = rows.combine_chunks()
            columns = {c: rows.column(c).to_numpy() for c in ("bucket", "low", "high", "own", "copies")}
            lists = {}
            for c in ("tokens", "paths"):
                found = rows.column(c).combine_chunks()
                found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
                lists[c] = found.offsets.to_numpy(), found.values.to_numpy()
            change = np.zeros(rows.num_rows, bool)
            for c in ("bucket", "low", "high"):
                change[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.append(np.concatenate([[0], np.flatnonzero(change)]), rows.num_rows)
            keys = rows.column("key").to_pylist()
            at, other, copies = [], [], []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                (cut, flat), (path_cut, path_flat) = lists["tokens"], lists["paths"]
                here = np.array(sorted({k: i for i, k in zip(range(a, b), keys[a:b])}.values()))
                tokens = [flat[cut[i] : cut[i + 1]] for i in here]
                paths = [path_flat[path_cut[i] : path_cut[i + 1]] for i in here]
                side = columns["own"][here] if columns["low"][a] != columns["high"][a] else None
                good = _compare(tokens, paths, columns["bucket"][a], side, similarity)
                some = np.flatnonzero(good.any(1))
                if not len(some):
                    continue
                good = good[np.ix_(some, some)]
                some = here[some]
                label = np.arange(len(some))
                while True:
                    low = np.minimum(label, np.where(good, label[None, :], len(some)).min(1))
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                star = np.flatnonzero(label != np.arange(len(some)))
                at += [some, some[star]]
                other += [np.full(len(some), -1), some[label[star]]]
                copies += [good @ columns["copies"][some], np.zeros(len(star), np.int64)]
            if not at:
                continue
            column, other = rows.column("key").combine_chunks(), np.concatenate(other)
            out = pa.Table.from_arrays(
                [
                    column.take(pa.array(np.concatenate(at))),
                    column.take(pa.array(other, mask=other < 0)),
                    pa.array(np.concatenate(copies).astype(np.int64)),
                ],
                ["key", "other", "copies"],
            )
            yield from out.combine_chunks().to_batches()

    return ready.select("bucket", "low", "high", "own", "key", "copies", "tokens", "paths").mapInArrow(
        run, "key binary, other binary, copies long"
    )


def wanted_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, copies, tokens) for the keys of ``wanted`` (key, text_id, copies), from one row each."""
    place = F.pmod(F.xxhash64("key"), F.lit(MAP_BITS))
    words = (
        wanted.select(F.shiftright(place, 6).cast("int").alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toPandas()  # at most MAP_BITS / 64 rows
    )
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            for part in slices(batch.filter(pa.array(hit.astype(bool))), "__text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("__id"), _token_lists(shingle_sets(part.column("__text")))], ["key", "__id", "tokens"]
                )

    # A row whose text may be wanted; the join keeps one row of each wanted text, but for rows
    # that repeat an id and a text, which links() takes as one.
    found = rows.select(F.col("__key").alias("key"), "__id", "__text").withColumn("place", place).mapInArrow(run, "key binary, __id long, tokens array<long>")
    same = (found["key"] == wanted["key"]) & found["__id"].eqNullSafe(wanted["text_id"])
    return _met(found, wanted, same).select(wanted["key"], "copies", "tokens")


def text_key(text: str) -> Column:
    """What texts are known by; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def _classes(docs: DataFrame, doc_id: str, text: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows (__id, __key, __text), and for each key its class and links."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("__id"), text_key(text).alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")
    )
    nodes = rows.groupBy(F.col("__key").alias("key")).agg(F.min("__id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(nodes, "join-nodes")

    rate = 1 / similarity
    members = cut_lineage(first_buckets(rows.select("__key", "__text"), rate, runs_for(recall)), "join-buckets")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    crowded = cut_lineage(sizes.filter(F.col("members") > SMALL), "join-crowded")
    if crowded.count() <= FEW_BUCKETS:  # else the joins below shuffle
        crowded = F.broadcast(crowded)
    large = cut_lineage(members.join(crowded, "bucket").select("bucket", "key", "n", "members"), "join-large")
    small = members.join(crowded.select("bucket"), "bucket", "left_anti")
    leaves = cut_lineage(prune(small, similarity), "join-pruned")
    leaves = _met(leaves, cut_lineage(live_buckets(leaves), "join-live"), "bucket").select("bucket", "key", "n")

    # Shingle sets of the texts that may have a partner.
    wanted = _met(leaves.select("key").unionByName(large.select("key")).distinct(), nodes, "key")
    wanted = cut_lineage(wanted.select("key", "text_id", "copies"), "join-wanted")
    sets = cut_lineage(wanted_sets(rows, wanted), "join-sets")

    for _ in range(DEPTH):
        parts = cut_lineage(split(large, sets, rate), "join-split")
        sizes = parts.groupBy("parent", "bucket").agg(F.count(F.lit(1)).alias("many"))
        work = sizes.groupBy("parent").agg(F.sum(F.col("many").cast("double") * F.col("many")).alias("work"))
        verdict = (
            _met(large.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")), work, F.col("bucket") == F.col("parent"), "left")
            .select("bucket", (F.coalesce("work", F.lit(0.0)) < 0.5 * F.col("many").cast("double") * F.col("many")).alias("splits"))
        )
        verdict = cut_lineage(verdict, "join-verdict")
        alike = _met(large, verdict.filter("not splits"), "bucket").select("bucket", "key", "n")
        leaves = leaves.unionByName(alike)
        parts = _met(parts, verdict.filter("splits").select(F.col("bucket").alias("parent")), "parent").select("bucket", "key", "n")
        smaller = cut_lineage(live_buckets(parts), "join-live")
        parts = cut_lineage(_met(parts, smaller, "bucket"), "join-members")
        leaves = leaves.unionByName(parts.filter(F.col("members") <= SMALL).select("bucket", "key", "n"))
        large = parts.filter(F.col("members") > SMALL)
    leaves = cut_lineage(leaves.unionByName(large.select("bucket", "key", "n")), "join-leaves")

    found = cut_lineage(links(leaves, sets, similarity), "join-links")
    totals = found.filter("other is null").groupBy("key").agg(F.sum("copies").alias("linked"))
    labels = connected_components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    grouped = _met(nodes, labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = F.min(F.struct(F.col("text_id").isNull().alias("null"), "text_id", "key"))
    classes = grouped.groupBy("label").agg(F.min("text_id").alias("class_id"), first["key"].alias("first_key"), F.sum("copies").alias("class_rows"))
    result = _met(_met(grouped, classes, "label"), totals, "key", "left")
    result = cut_lineage(
        result.select(
            F.col("key").alias("__key"), "class_id", "text_id", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "first_key", "class_rows"
        ),
        "join-classes",
    )
    return rows, result


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """One row per document: doc_id, class_id, text_id, n_copies, n_links.

    Linked are documents whose sets of five-word shingles have a Jaccard similarity of at least
    ``similarity`` (a text of fewer words is one shingle), and documents with equal texts.
    ``class_id`` is the smallest doc_id of a connected class, ``text_id`` that of the equal texts,
    ``n_copies`` their number, ``n_links`` the number of other rows linked with the row.  Null texts
    count as empty; texts without a word are linked with equal ones only.  Null ids come last.
    """
    rows, result = _classes(docs, doc_id, text, similarity, recall)
    return _met(rows.select("__id", "__key"), result, "__key").select(
        F.col("__id").alias(doc_id), "class_id", "text_id", F.col("copies").alias("n_copies"), "n_links"
    )


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """(doc_id, text_key, kept): each id and text once, of the classes of two or more rows.

    The classes are those of :func:`near_duplicates`.  ``kept`` is true for one id and text of a
    class, that of smallest id (null last), then key; rows may repeat it.
    """
    rows, result = _classes(docs, doc_id, text, similarity, recall)
    members = _met(rows.select("__id", "__key"), result.filter("class_rows > 1"), "__key")
    kept = F.col("__id").eqNullSafe(F.col("class_id")) & (F.col("__key") == F.col("first_key"))
    return members.select(F.col("__id").alias(doc_id), F.col("__key").alias("text_key"), kept.alias("kept")).distinct()
