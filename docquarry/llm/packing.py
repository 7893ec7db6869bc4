"""Best-fit packing of token sequences by a histogram of lengths.

Documents become pieces of at most ``capacity`` ids.  Best fit (longest first) runs on the
histogram, which has at most ``capacity`` entries whatever the corpus: open sequences with the
same free space are one group, and whole groups are filled at once.  The plan tells, for each
length, which ranks go to which sequences.  Each piece then takes the slot of its rank within
its length; ranks come from counts per (writer task, length), so nothing is sorted as a whole.
"""

from __future__ import annotations

import bisect
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from docquarry.llm.common import shuffle_parts, slices
from docquarry.session import compute_once, work_folder

#: Chunks whose ids a worker keeps; a full table is reduced to what is in use.
KEPT_CHUNKS = 450_000
#: Longer words, in bytes, go to the tokenizer library itself.
LONGEST_WORD = 32
#: Space other than 9 to 13 and 32, and controls that some libraries take for space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters of which normalisation and lower case need no context.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")
_PLAIN_TEXT = re.compile("[\t-\r\x20-\x7e\xa1-\xff]*")
#: A stop or comma right after another mark; elsewhere a blank before it changes no piece.
_MARKS = re.compile(r"(?:[^\w\s]|_)[.,]")
_NONE = np.iinfo(np.int32).max


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies (a public rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """A tokenizer file with word ends, for whole corpora.

    Plain words are merged many at a time, as rows of a matrix: in each step every word joins
    its pair of least rank, the leftmost on ties.  Everything else goes to the library.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.match = regex.compile(split["pattern"]["Regex"]).findall
        letters = _byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.bits = 19
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        for rank, key in enumerate((left << 20 | right).tolist()):
            at = self._slot(key)
            while self.slots[at] not in (-1, key):
                at = (at + 1) & (size - 1)
            if self.slots[at] == -1:
                self.slots[at], self.ranks[at] = key, rank
        self.chunks: dict[str, bytes] = {}

    def _slot(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        out = np.where(self.slots[at] == key, self.ranks[at], _NONE)
        open_ = np.flatnonzero((self.slots[at] != key) & (self.slots[at] != -1) & (left >= 0) & (right >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[at[open_]]
            hit = open_[held == key[open_]]
            out[hit] = self.ranks[at[hit]]
            open_ = open_[(held != key[open_]) & (held != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (unsigned 16-bit) of words of at most LONGEST_WORD bytes each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max()) + 1
        ids = np.full((len(words), width), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        ids[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = self.inner[flat]
        ids[np.arange(len(words)), sizes - 1] = self.final[flat[ends - 1]]
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        columns = np.arange(width)
        live = np.arange(len(words))
        while True:
            best = ranks[live].argmin(1)
            least = ranks[live, best]
            keep = least != _NONE
            live, best, least = live[keep], best[keep], least[keep]
            if not len(live):
                break
            shift = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            moved = np.take_along_axis(ids[live], shift, 1)
            moved_ranks = np.take_along_axis(ranks[live], shift, 1)
            moved[:, -1], moved_ranks[:, -1] = -1, _NONE
            n = np.arange(len(live))
            moved[n, best] = self.made[least]
            following = np.minimum(best + 1, width - 1)
            moved_ranks[n, best] = self._rank(moved[n, best], moved[n, following])
            inner = best > 0
            at = best[inner] - 1
            moved_ranks[n[inner], at] = self._rank(moved[n[inner], at], moved[n[inner], at + 1])
            ids[live], ranks[live] = moved, moved_ranks
        used = (ids >= 0).sum(1)
        flat_ids = ids[ids >= 0].astype("<u2").tobytes()
        stops = np.cumsum(used) * 2
        return [flat_ids[a:b] for a, b in zip((stops - used * 2).tolist(), stops.tolist())]

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _pieces(self, chunk: str) -> list[str]:
        """What the pattern finds in a plain chunk; words, and words before a stop, without it."""
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".," and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.match(low)

    def _learn(self, missing: set[str]) -> None:
        """Fill the table of chunks.  A piece is a chunk too, with the same ids."""
        chunks = self.chunks
        plain = [c for c in missing if _PLAIN.fullmatch(c)]
        if len(plain) < len(missing):
            for c in missing.difference(plain):
                chunks[c] = self._library(c)
        # Most are words in lower case, each a piece of its own.
        words, plain = [c for c in plain if c.isalpha() and c.islower()], [c for c in plain if not (c.isalpha() and c.islower())]
        pieces = list(map(self._pieces, plain))
        new = {w for p in pieces for w in p}.difference(chunks)
        new.update(words)
        raw = [(w, w.encode()) for w in new]
        for least, most in ((1, 8), (9, 16), (17, LONGEST_WORD)):
            some = [x for x in raw if least <= len(x[1]) <= most]
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                chunks.update(zip([w for w, _ in part], self._merge_all([b for _, b in part])))
        for w, b in raw:
            if len(b) > LONGEST_WORD:
                chunks[w] = self._library(w)
        for chunk, found in zip(plain, pieces):
            if len(found) == 1:
                chunks[chunk] = chunks[found[0]]
            else:
                chunks[chunk] = b"".join([chunks[w] for w in found])

    def _chunks(self, text: str) -> list[str] | None:
        """Parts of a text that are coded apart, as few different ones as can be."""
        if _PLAIN_TEXT.fullmatch(text):
            text = text.lower()
            if not _MARKS.search(text):
                text = text.replace(",", " ,").replace(".", " .")
        elif _ODD_SPACE.search(text):
            return None
        return text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        parts = [self._chunks(t) for t in texts]
        used = set().union(*filter(None, parts))
        missing = used.difference(self.chunks)
        if len(self.chunks) + len(missing) > KEPT_CHUNKS:  # what this call uses stays
            self.chunks = {c: self.chunks[c] for c in used.difference(missing)}
            if len(used) > KEPT_CHUNKS and len(texts) > 1:
                middle = len(texts) // 2
                return self.encode_all(texts[:middle]) + self.encode_all(texts[middle:])
        self._learn(missing)
        ids = self.chunks.__getitem__
        return [self._library(t) if p is None else b"".join(map(ids, p)) for t, p in zip(texts, parts)]


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """One coder per worker process."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Pieces with their ids, the task that wrote them and the rank within length in that task."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = coder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in slices(batch, "__text", 1 << 21):
                ids, piece, start, length, rank, out = [], [], [], [], [], []
                for i, coded in zip(part.column("__id").to_pylist(), bpe.encode_all(part.column("__text").to_pylist())):
                    wide = np.frombuffer(coded + end, "<u2").astype("<u4")
                    for k, at in enumerate(range(0, len(wide), capacity)):
                        one = wide[at : at + capacity]
                        ids.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(one))
                        rank.append(int(seen[len(one)]))
                        seen[len(one)] += 1
                        out.append(one.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(out, pa.binary()),
                        pa.array([task] * len(ids), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "token_ids", "task", "local_rank"],
                )

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, token_ids binary, task int, local_rank long")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence, per, offset): from this rank on, pieces of this length go
    to consecutive sequences, ``per`` to each, the first of them at ``offset``."""
    by_space: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, how many)
    spaces: list[int] = []
    plan, following = [], 0

    def put(space: int, first: int, many: int) -> None:
        if not many or not space:
            return
        if space not in by_space:
            by_space[space] = []
            bisect.insort(spaces, space)
        by_space[space].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space], spaces[at]
            else:
                space, first, many = capacity, following, -(-left // (capacity // length))
                following += many
            per = min(space // length, left)
            taken = min(many, left // per)
            plan.append((length, rank, first, per, capacity - space))
            put(space - per * length, first, taken)
            put(space, first + taken, many - taken)
            rank += taken * per
            left -= taken * per
    return np.array(plan, np.int64).reshape(-1, 5)


def best_fit_pack(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, token_ids, sequence_id, offset.

    ``token_ids`` are little-endian unsigned 32-bit integers.  A document is its ids and then
    ``end_id``; only documents longer than ``capacity`` are cut.  Null texts count as empty (one
    piece of one id); rows that are alike are documents of their own; an empty table gives none.
    ``vocabulary`` is the path of a tokenizer file that every executor can open.
    """
    spark = docs.sparkSession
    pieces = _stored_by_task(pieces_of(docs, vocabulary, capacity, end_id, doc_id, text))
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(histogram, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
        nth = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length})

    # A row a task, small enough to be hashed; the pieces lie by task already and don't move.
    ranked = pieces.join(_by_length(base).hint("shuffle_hash"), "task").withColumn(
        "rank", F.get("bases", F.col("length").cast("int")) + F.col("local_rank")
    )
    ranked = compute_once(ranked.select("doc_id", "piece", "start", "length", "token_ids", "bases", "rank"), "rank").drop("bases")
    placed = ranked.withColumn("__slot", slot("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "token_ids", "__slot.sequence_id", "__slot.offset")


def _stored_by_task(pieces: DataFrame) -> DataFrame:
    """The pieces, written as a table in buckets of the task that made them: a file a task.

    A join on the task then reads them where they lie, without a shuffle of their ids.
    """
    spark = pieces.sparkSession
    name = f"packing_pieces_{uuid.uuid4().hex}"
    writer = pieces.write.option("compression", "zstd").option("path", work_folder(spark, "packing-pieces"))
    writer.bucketBy(2 * shuffle_parts(spark), "task").saveAsTable(name)
    return spark.table(name)


def _by_length(base: DataFrame) -> DataFrame:
    """(task, bases): for each task an array that holds the base of a length at that place."""
    held = F.sort_array(F.collect_list(F.struct("length", "base")))
    none = F.lit(0).cast("long")
    gap = lambda x, i: (x["length"] - F.when(i > 0, F.get("held", i - 1)["length"]).otherwise(F.lit(-1)) - 1).cast("int")
    whole = F.flatten(F.transform("held", lambda x, i: F.concat(F.array_repeat(none, gap(x, i)), F.array(x["base"]))))
    return base.groupBy("task").agg(held.alias("held")).select("task", whole.alias("bases"))
