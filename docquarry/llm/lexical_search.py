"""The highest-scoring documents of each query, by range maxima over posting lists.

Documents stay where they are read: each task turns its documents into blocks of posting lists
for the terms that the queries ask for, and the blocks are written.  Document frequencies come from
the lengths of the lists.  A block is then searched for all queries at once in memory: a sparse
table over its postings answers which posting of a list has the highest impact between two
documents, and the sum of these maxima bounds every document between them.  The interval with the
highest bound is split at its document of highest impact, which is scored in full, until no bound
reaches the worst of the best ``k``.  Only these leave a task.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms; each block reads all documents once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, ascii_uppercase
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from docquarry.llm.common import slices, text_buffers, word_hashes, word_places
from docquarry.session import cut_lineage, spread

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of queries that a task holds at a time (an item isn't cut).
BLOCK_TERMS = 1 << 20
#: A block of documents is closed when it has so many documents or postings.
BLOCK_DOCS = 1 << 16
BLOCK_POSTINGS = 1 << 20
#: Intervals split at a time, and postings of an interval that is scored as a whole.
BATCH = 64
LEAF = 128

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms_of(text):
    """Terms of a text column, each once."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.translate(t, ascii_uppercase, ascii_lowercase)))


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of characters other than ASCII control characters, blanks and punctuation,
    with A-Z in lower case; a null text has none.  Weights and scores follow the integer formulas
    of :func:`weight` and :func:`impacts`.  Documents without a score above 0 are left out.  Equal
    scores are ordered by ascending id (null last).  Rows that share an item id are one item with
    the terms of all; rows that share a document id are documents of their own.  No documents or
    no items give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item"), F.explode(terms_of(F.col(f"`{item_text}`"))).alias("term"))
    asked = cut_lineage(asked.distinct(), "item-terms")
    n_blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    kind = docs.select(f"`{doc_id}`").schema[0].dataType.simpleString()
    rows = spread(docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")))
    found = []
    for i in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i).collect()
        found.append(_search_block(rows, [tuple(r) for r in block], asked.schema["item"].dataType.simpleString(), kind, k))
    best = reduce(DataFrame.unionByName, found)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _search_block(rows: DataFrame, asked: list[tuple], item_kind: str, kind: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    terms = sorted({t for _, t in asked})
    number = {t: i for i, t in enumerate(terms)}
    by_item: dict = {}
    for item, term in asked:
        by_item.setdefault(item, []).append(number[term])
    names = list(by_item)
    index = cut_lineage(rows.mapInArrow(_indexer(terms, kind), f"ids array<{kind}>, {_INDEX}"), "postings")
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    counted = index.select("terms", "sizes").mapInArrow(_frequencies(len(terms)), "term int, df long")
    held = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = np.array([weight(whole["n"] or 0, held.get(i, 0)) for i in range(len(terms))], np.int64)
    wanted = [np.array(sorted(by_item[x]), np.int64) for x in names]
    best = index.select("ids", "lengths", "terms", "sizes", "places", "counts").mapInArrow(
        _searcher(wanted, weights, whole["n"] or 0, whole["l"] or 0, k, kind), f"no int, doc {kind}, score long"
    )
    named = spark.createDataFrame(list(enumerate(names)), f"no int, item {item_kind}")
    return best.join(F.broadcast(named), "no").select("item", "doc", "score")  # items of one block


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What postings add to the score of their documents."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def length_norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document; beyond 64 bits the product is taken in whole numbers of any size."""
    if len(lengths) and 50 * int(lengths.max()) * n >= 1 << 63:
        return (50 + (50 * n * lengths.astype(object)) // total).astype(np.int64)
    return 50 + (50 * n * lengths) // total


# --- index ----------------------------------------------------------------------------

#: A block: documents in order of their ids, and per term the places of its documents.
_INDEX = "lengths binary, terms binary, sizes binary, places binary, counts binary, n_docs long, n_terms long"


def _indexer(terms: list[str], kind: str):
    hashes, _ = word_hashes(pa.array(terms, pa.string()))
    if len(np.unique(hashes)) != len(terms):
        raise ValueError("two terms of the queries have one hash")
    order = np.argsort(hashes)
    hashes, bytes_of = hashes[order], np.array([len(t.encode()) for t in terms], np.int64)[order]

    def matches(batch: pa.RecordBatch):
        """Terms per document; document, term and count of each posting."""
        data, cuts = text_buffers(batch.column("text"))
        words, per_doc, starts, stops = word_places(_FOLD[data], cuts)
        at = np.minimum(np.searchsorted(hashes, words), max(len(hashes) - 1, 0))
        hit = (hashes[at] == words) & (bytes_of[at] == stops - starts) if len(hashes) else np.zeros(len(words), bool)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)[hit]
        pair, count = np.unique(doc * max(len(terms), 1) + order[at[hit]], return_counts=True)
        return per_doc, pair // max(len(terms), 1), pair % max(len(terms), 1), count

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        docs = postings = n_docs = n_terms = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                per_doc, doc, term, count = matches(batch)
                n_docs += int((per_doc > 0).sum())
                n_terms += int(per_doc.sum())
                some, doc = np.unique(doc, return_inverse=True)
                if len(some):
                    held.append((batch.column("doc").take(pa.array(some)), per_doc[some], doc + docs, term, count))
                    docs, postings = docs + len(some), postings + len(doc)
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block_of(held, n_docs, n_terms)
                    held, docs, postings, n_docs, n_terms = [], 0, 0, 0, 0
        if n_docs:
            yield block_of(held, n_docs, n_terms)

    def block_of(held, n_docs: int, n_terms: int) -> pa.RecordBatch:
        if held:
            columns = list(zip(*held))
            ids, lengths = pa.concat_arrays(columns[0]), np.concatenate(columns[1])
            doc, term, count = (np.concatenate(c) for c in columns[2:])
            in_order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
            place = np.empty(len(in_order), np.int64)
            place[in_order] = np.arange(len(in_order))
            ids, lengths, doc = ids.take(pa.array(in_order)), lengths[in_order], place[doc]
            by = np.lexsort((doc, term))
            doc, term, count = doc[by], term[by], count[by]
        else:
            ids, lengths = pa.nulls(0, pa.null()), np.zeros(0, np.int64)
            doc = term = count = np.zeros(0, np.int64)
        held_terms, sizes = np.unique(term, return_counts=True)
        numbers = [lengths.astype("<i8"), held_terms.astype("<i4"), sizes.astype("<i4"), doc.astype("<i4"), count.astype("<i4")]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [lists, *[pa.array([x.tobytes()], pa.binary()) for x in numbers], pa.array([n_docs]), pa.array([n_terms])],
            ["ids", "lengths", "terms", "sizes", "places", "counts", "n_docs", "n_terms"],
        )

    return build


def _numbers(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _frequencies(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total[_numbers(batch.column("terms")[i], "<i4")] += _numbers(batch.column("sizes")[i], "<i4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "df"])

    return count


# --- search ---------------------------------------------------------------------------


class Block:
    """Posting lists of one block, one after the other, with a sparse table of range maxima."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, impact: np.ndarray):
        self.terms, self.places, self.impact = terms, places.astype(np.int64), impact
        self.cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        #: List and document in one number, so that one search finds a document in many lists.
        self.where = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) | self.places
        longest = int(sizes.max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(1, longest.bit_length()):
            self.log[1 << i :] += 1
        # tables[i, p]: posting of highest impact among the 2**i from p on.  Ranges that go over the
        # end of a list are never asked for.
        self.tables = np.empty((longest.bit_length(), len(places)), np.int32)
        self.tables[0] = np.arange(len(places))
        for i in range(1, len(self.tables)):
            half, above = 1 << (i - 1), self.tables[i - 1]
            left, right = above[:-half], above[half:]
            self.tables[i, :-half] = np.where(impact[left] >= impact[right], left, right)
            self.tables[i, -half:] = above[-half:]

    def highest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting of highest impact in each range of a list, and its impact (an empty range: 0)."""
        some = high > low
        level = self.log[np.where(some, high - low, 1)]
        low = np.where(some, low, 0)
        left = self.tables[level, low]
        right = self.tables[level, np.where(some, high - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        return best, np.where(some, self.impact[best], 0)

    def search(self, wanted: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score of at least ``floor`` (1 or more)."""
        lists = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.cuts[lists][None, :], self.cuts[lists + 1][None, :]
        bound = self.highest(low, high)[1].sum(1)
        while True:
            least = max(floor, int(scores[k - 1])) if len(scores) >= k else floor
            open_ = bound >= least
            if not open_.any():
                return places, scores
            low, high, bound = low[open_], high[open_], bound[open_]
            now = np.zeros(len(bound), bool)
            now[np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else slice(None)] = True
            at_low, at_high = low[now], high[now]
            low, high, bound = low[~now], high[~now], bound[~now]
            few = (at_high - at_low).sum(1) <= LEAF
            new = [self._leaves(at_low[few], at_high[few])]
            at_low, at_high = at_low[~few], at_high[~few]
            if len(at_low):
                best, value = self.highest(at_low, at_high)
                split = self.places[best[np.arange(len(best)), value.argmax(1)]][:, None]
                at = np.searchsorted(self.where, (lists << 32)[None, :] | split)
                held = at < at_high
                held[held] = self.places[at[held]] == np.broadcast_to(split, at.shape)[held]
                new.append((split[:, 0], np.where(held, self.impact[np.where(held, at, 0)], 0).sum(1)))
                parts = np.concatenate([at_low, at + held]), np.concatenate([at, at_high])
                low, high = np.concatenate([low, parts[0]]), np.concatenate([high, parts[1]])
                bound = np.concatenate([bound, self.highest(*parts)[1].sum(1)])
            places = np.concatenate([places, *[p for p, _ in new]])
            scores = np.concatenate([scores, *[s for _, s in new]])
            enough = np.flatnonzero(scores >= floor)
            top = enough[np.lexsort((places[enough], -scores[enough]))[:k]]
            places, scores = places[top], scores[top]

    def _leaves(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents of these ranges with their scores; ranges of one list don't overlap."""
        sizes = (high - low).ravel()
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.repeat(low.ravel() - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        by = np.argsort(self.places[at], kind="stable")
        place = self.places[at][by]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        return place[first], np.add.reduceat(self.impact[at][by], first)


def _searcher(wanted: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int, kind: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in wanted]
        id_type = None
        for batch in batches:
            id_type = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                lengths, terms, sizes, places, counts = (
                    _numbers(batch.column(c)[i], t) for c, t in (("lengths", "<i8"), ("terms", "<i4"), ("sizes", "<i4"), ("places", "<i4"), ("counts", "<i4"))
                )
                if not len(places):
                    continue
                ids, norms = batch.column("ids")[i].values, length_norms(lengths, n, total)
                impact = impacts(np.repeat(weights[terms], sizes), counts.astype(np.int64), norms[places])
                block = Block(terms, sizes, places, impact)
                for x, terms_of_item in enumerate(wanted):
                    # A document below the worst of k that this task has found can't be among the best.
                    floor = best[x][-1][0] if len(best[x]) >= k else 1
                    at, scores = block.search(terms_of_item, k, max(1, floor))
                    if len(at):
                        more = list(zip(scores.tolist(), ids.take(pa.array(at)).to_pylist()))
                        best[x] = sorted(best[x] + more, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]
        if id_type is not None:
            for x, rows in enumerate(best):
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(rows), pa.int32()), pa.array([d for _, d in rows], id_type), pa.array([s for s, _ in rows], pa.int64())],
                        ["no", "doc", "score"],
                    )

    return search
