"""Nearest neighbours by multi-index hashing of learned binary codes.

An orthogonal rotation of the principal axes, fitted on a bounded sample to lose least by taking
signs, gives each vector a code.  Codes are cut into substrings of eight bits with one index
each.  Two codes within a Hamming radius r agree to r // substrings bits in some substring
(pigeonhole), so probing all substring values that near finds every code within r.  Candidates
within r are ranked by their exact distance where they are found, and only the best few of each
probed block travel on.

The radius is the one that holds ``recall`` of the true neighbours inside the sample; in more
rows neighbours are nearer.  Queries that have fewer than k rows within it are probed again at
wider radii, in the end against all rows.  Frequent substring values are cut into blocks of bounded size on
both sides, so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from docquarry.llm.common import whole_groups
from docquarry.session import cut_lineage

#: Rows at most that the rotation and the radius are fitted on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 10_000, 200
BITS, SUBSTRING = 64, 8
BLOCK, QUERY_BLOCK = 1024, 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """Rotation to signs: ``of(vectors)`` are codes as unsigned 64-bit numbers."""

    def __init__(self, vectors: np.ndarray, rounds: int = 30):
        self.mean = vectors.mean(0)
        centred = vectors - self.mean
        bits = min(BITS, vectors.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)
        turned = centred @ axes[:, ::-1][:, :bits]
        rotation, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = (u @ v).T
        self.turn = axes[:, ::-1][:, :bits] @ rotation
        self.bits = bits
        self.parts = -(-bits // SUBSTRING)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = ((vectors - self.mean) @ self.turn >= 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def fit_radius(codes: Codes, vectors: np.ndarray, k: int, recall: float) -> int:
    """Least radius that holds ``recall`` of the k nearest of sampled queries within the sample."""
    if len(vectors) <= k + 1:
        return codes.bits
    chosen = np.arange(0, len(vectors), max(1, len(vectors) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    code, squares, seen = codes.of(vectors), (vectors**2).sum(1), []
    for at in range(0, len(chosen), 50):
        q = chosen[at : at + 50]
        far = squares[None, :] - 2 * vectors[q] @ vectors.T
        far[np.arange(len(q)), q] = np.inf
        near = np.argpartition(far, k, 1)[:, :k]
        seen.append(ones(code[q][:, None] ^ code[near]).ravel())
    return int(np.quantile(np.concatenate(seen), recall, method="higher"))


def wider(radius: int, codes: Codes) -> int:
    """The next radius: one more bit in each substring, or all bits where that probes more than a scan."""
    reach = radius // codes.parts + 1
    probed = int((_ONES <= reach).sum()) * codes.parts
    return min(codes.bits, (reach + 1) * codes.parts - 1) if probed < len(_ONES) else codes.bits


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    recall: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by Euclidean distance.

    Both tables have ``vec_id`` and ``vector``.  A row with the id of the query is never its
    answer; ties go to the smaller id; rows that repeat an id and a vector count once.  Null ids,
    vectors that are null, zero or of another length than the sample's, and vectors with a null
    or non-finite component take no part; without vectors the result is empty.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)

    base = clean(vectors).distinct()
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    lengths = [len(r["v"]) for r in sample]
    size = max(set(lengths), key=lengths.count) if lengths else 1
    known = np.array([r["v"] for r in sample if len(r["v"]) == size] or np.eye(1))
    codes = Codes(known)
    radius = fit_radius(codes, known, k, recall)
    shared = spark.sparkContext.broadcast(codes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.of(flat).view(np.int64))], ["id", "v", "code"])

    def coded(df: DataFrame, purpose: str) -> DataFrame:
        return cut_lineage(df.filter(F.size("v") == size).mapInArrow(code, "id long, v array<double>, code long"), purpose)

    index = coded(base, "ann-index")
    asked = coded(clean(queries).distinct(), "ann-queries")
    def probe(asked: DataFrame, radius: int) -> DataFrame:
        """(query_id, vec_id, score): the best k of each block within ``radius``."""
        scan = radius >= codes.bits  # one bucket with every row
        reach = radius // codes.parts
        values = F.array(*[F.lit(0) if scan else F.shiftrightunsigned("code", SUBSTRING * i).bitwiseAND(255).cast("int") for i in range(1 if scan else codes.parts)])
        entries = index.select("id", "v", "code", F.posexplode(values).alias("part", "value"))
        masks = F.array(*[F.lit(x) for x in range(1 if scan else 256) if _ONES[x] <= reach])
        probes = asked.select("id", "v", "code", F.posexplode(values).alias("part", "value")).withColumn(
            "value", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("value"))))
        )

        def blocks(df: DataFrame, of: int, name: str) -> DataFrame:  # at most 256 * parts rows
            return df.groupBy("part", "value").agg(F.ceil(F.count(F.lit(1)) / of).cast("int").alias(name))

        both = F.broadcast(blocks(entries, BLOCK, "blocks").join(blocks(probes, QUERY_BLOCK, "query_blocks"), ["part", "value"]))

        def dealt(df: DataFrame, own: str, many: str, other: str, many_others: str, asks: bool) -> DataFrame:
            return (
                df.join(both, ["part", "value"])
                .withColumn(own, F.pmod(F.xxhash64("id", "code"), F.col(many)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(many_others) - 1)))
                .select("part", "value", "block", "query_block", F.lit(asks).alias("asks"), "id", "code", "v")
            )

        keys = ("part", "value", "block", "query_block")
        met = (
            dealt(entries, "block", "blocks", "query_block", "query_blocks", False)
            .unionByName(dealt(probes, "query_block", "query_blocks", "block", "blocks", True))
            .repartition(*keys)
            .sortWithinPartitions(*keys)
        )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in whole_groups(batches, keys, 1024):
                key = np.column_stack([rows.column(c).to_numpy() for c in keys])
                starts = np.append(np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]), len(key))
                asks, ids = rows.column("asks").to_numpy(), rows.column("id").to_numpy()
                code = rows.column("code").to_numpy().view(np.uint64)
                v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
                found = []
                for a, b in zip(starts[:-1], starts[1:]):
                    q, c = np.flatnonzero(asks[a:b]) + a, np.flatnonzero(~asks[a:b]) + a
                    if not len(q) or not len(c):
                        continue
                    differ = code[q][:, None] ^ code[c][None, :]
                    good = (ones(differ) <= radius) & (ids[q][:, None] != ids[c][None, :])
                    for part in range(key[a, 0]):  # an earlier index has found it
                        good &= ones(differ >> np.uint64(SUBSTRING * part) & np.uint64(255)) > reach
                    i, j = np.nonzero(good)
                    score = np.empty(len(i))
                    for at in range(0, len(i), 16_384):
                        some = slice(at, at + 16_384)
                        score[some] = np.sqrt(((v[q[i[some]]] - v[c[j[some]]]) ** 2).sum(1))
                    order = np.lexsort((ids[c[j]], score, i))
                    i, j, score = i[order], j[order], score[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    best = nth < k
                    found.append((ids[q[i[best]]], ids[c[j[best]]], score[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])

        return met.mapInArrow(search, "query_id long, vec_id long, score double")

    def ranked(hits: DataFrame) -> DataFrame:
        best = W.partitionBy("query_id").orderBy("score", "vec_id")
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = ranked(probe(asked, radius))
    while radius < codes.bits:  # queries with fewer than k rows within the radius look further
        found = cut_lineage(found, "ann-found")
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
        short = cut_lineage(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "ann-short")
        if short.isEmpty():
            break
        radius = wider(radius, codes)
        found = found.join(full, "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(ranked(probe(short, radius)))
    return found
