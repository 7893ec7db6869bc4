"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary.  Each language has a probability for every piece,
from counts over all training documents.  The likelihood of a word is the sum over all ways to
cut it into pieces, by the forward algorithm; that of a text is the product over its words (no
piece of the vocabulary reaches over a blank), so distinct words are scored once, many at a
time.  A code point that is no piece counts as the byte pieces it is coded with.  Words are taken
in lower case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import is_training, mix, slices

#: Distinct words that a worker keeps at a time.
KEPT_WORDS = 250_000
#: Positions of a word whose pieces are looked up at a time.
AT_ONCE = 16
#: Code points of words that are scored at a time (a longer word is alone).
CELLS = 200_000
#: Weight, in pieces, of the mean of all languages in the counts of each.
SMOOTHING = 2000.0
#: Probability of a code point that is no piece and has a byte that no language was seen with.
UNKNOWN = 1e-9
_LETTER = regex.compile(r"\p{L}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_models: dict[str, object] = {}


def segmenter(path: str):
    """One sentencepiece model per worker process."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


class Prefixes:
    """All prefixes of the pieces, by hash: the piece that ends there, or -1."""

    def __init__(self, pieces: list[str]):
        held: dict[int, int] = {}
        self.longest = max(map(len, pieces), default=1) or 1
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                held.setdefault(h, -1)
            if piece:
                held[h] = i
        self.bits = max(10, (4 * len(held)).bit_length())
        size = 1 << self.bits
        self.keys, self.piece = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        keys = np.fromiter(held, np.uint64, len(held))
        values = np.fromiter(held.values(), np.int32, len(held))
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.piece[at[todo]] == -2]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.piece[at[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece; -1: a prefix only; -2: neither."""
        at = self._slot(h)
        out = self.piece[at]
        open_ = np.flatnonzero((out != -2) & (self.keys[at] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.piece[at[open_]]
            out[open_] = got
            open_ = open_[(got != -2) & (self.keys[at[open_]] != h[open_])]
        return out


def lone_points(points: np.ndarray, probability: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """Probability of code points that are no piece: that of their bytes, UNKNOWN where one of them has none."""
    out = np.full((len(points), probability.shape[1]), UNKNOWN)
    for n, point in enumerate(points.tolist()):
        coded = fallback[list(chr(point).encode("utf-8", "surrogatepass"))]
        if (coded >= 0).all():
            out[n] = probability[coded].prod(0)
    return out


def forward(words: list[str], prefixes: Prefixes, probability: np.ndarray, fallback: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood of each word, of any length, under each language.

    ``fallback`` has the piece of each byte, or -1.  Sums are kept for as many positions as the
    longest piece reaches over, and divided by the sum at hand every few positions.
    """
    fallback = np.full(256, -1) if fallback is None else fallback
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    by_size = np.argsort(sizes, kind="stable")
    ordered = sizes[by_size]
    ring = np.zeros((prefixes.longest + 1, len(words), probability.shape[1]))
    ring[0] = 1
    scale, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
    for block in range(0, int(ordered[-1]) + 1, AT_ONCE):
        # All pieces that start in these positions, then the sums from position to position.
        live = by_size[np.searchsorted(ordered, block, "right") :]
        many = np.minimum(sizes[live] - block, AT_ONCE)
        word = np.repeat(live, many)
        start = block + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        on, h, step, found = np.arange(len(word)), np.zeros(len(word), np.uint64), 0, []
        while len(on):
            h = h * _BASE + flat[begin[word[on]] + start[on] + step] + np.uint64(1)
            step += 1
            piece = prefixes.find(h)
            whole = piece >= 0
            found.append((on[whole], np.full(int(whole.sum()), step), piece[whole]))
            if step == 1:
                lone = on[~whole]
            more = (piece > -2) & (sizes[word[on]] > start[on] + step)
            on, h = on[more], h[more]
        points, which = np.unique(flat[begin[word[lone]] + start[lone]], return_inverse=True)
        alone = lone_points(points, probability, fallback)
        at, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(start[at], kind="stable")
        at, length, piece = at[order], length[order], piece[order]
        order = np.argsort(start[lone], kind="stable")
        lone, which = lone[order], which[order]
        places = np.arange(block, block + AT_ONCE + 1)
        cuts, lone_cuts = np.searchsorted(start[at], places), np.searchsorted(start[lone], places)
        ends = np.searchsorted(ordered, places)
        for i in range(block, min(block + AT_ONCE, int(ordered[-1]) + 1)):
            here = ring[i % len(ring)]
            if i % 4 == 3:
                by = np.where(here > 0, here, 1.0)
                ring /= by
                scale += np.log(by)
            n = i - block
            done = by_size[ends[n] : ends[n + 1]]
            out[done] = np.log(np.maximum(here[done], 1e-300)) + scale[done]
            some = slice(cuts[n], cuts[n + 1])
            w = word[at[some]]
            # one word has one piece of each length here, so no place comes twice
            ring[(i + length[some]) % len(ring), w] += here[w] * probability[piece[some]]
            some = slice(lone_cuts[n], lone_cuts[n + 1])
            w = word[lone[some]]
            ring[(i + 1) % len(ring), w] += here[w] * alone[which[some]]
            here[:] = 0
    return out


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of about one length, so many that they have a bounded number of code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        fit = np.arange(1, min(5_000, len(order) - at) + 1) * sizes[order[at : at + 5_000]] <= CELLS
        end = at + max(1, int(fit.sum()))
        yield order[at:end]
        at = end


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(lang, piece, n) over all rows of (__text, __lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(vocabulary)
        words: dict[str, Counter] = {}
        counts: dict[str, np.ndarray] = {}

        def flush():
            for lang, seen in words.items():
                coded = model.encode(list(seen), num_threads=1)
                if lang not in counts:
                    counts[lang] = np.zeros(model.get_piece_size())
                of = np.fromiter((i for ids in coded for i in ids), np.int64)
                weight = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), np.fromiter(map(len, coded), np.int64, len(coded)))
                counts[lang] += np.bincount(of, weight, len(counts[lang]))
            words.clear()

        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                for text, lang in zip(part.column("__text").to_pylist(), part.column("__lang").to_pylist()):
                    words.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, words.values())) > KEPT_WORDS:
                    flush()
        flush()
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some].astype(np.int64))], ["lang", "piece", "n"]
            )

    return docs.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def language_ids(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 3,
    held_out: int = 1,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from rows with a language whose crc32 of the id's text is not ``held_out`` modulo
    ``folds``.  ``score`` is the share of the language in the sum of likelihoods.  Null texts,
    texts without a letter, and all texts if nothing could be learnt, are ``und`` with score 0.
    At most vocabulary times languages counts reach the driver.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), F.col(f"`{lang}`").cast("string").alias("__lang")
    )
    train = rows.filter(F.col("__lang").isNotNull() & is_training("__id", folds, held_out)).select("__text", "__lang")
    found = count_pieces(train, vocabulary).toPandas()
    model = segmenter(vocabulary)
    langs = sorted(found["lang"].unique())
    counts = np.zeros((model.get_piece_size(), max(1, len(langs))))
    for i, name in enumerate(langs):
        some = found[found["lang"] == name]
        counts[some["piece"], i] = some["n"]
    share = counts / np.maximum(counts.sum(0), 1)
    mean = (share.mean(1) + 1e-3 / len(counts)) / (1 + 1e-3)
    probability = (counts + SMOOTHING * mean[:, None]) / (counts.sum(0) + SMOOTHING)
    pieces = [
        "" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i) for i in range(len(counts))
    ]
    fallback = np.full(256, -1)
    for i in range(len(counts)):
        if model.is_byte(i) and counts[i].any():
            fallback[int(model.id_to_piece(i)[3:-1], 16)] = i
    shared = docs.sparkSession.sparkContext.broadcast((pieces, probability.astype(np.float32), langs, fallback))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probability, langs, fallback = shared.value
        probability = probability.astype(np.float64)
        prefixes = Prefixes(pieces)
        index: dict[str, int] = {}
        logs = np.zeros((0, probability.shape[1]))

        def learn(missing: list[str]):
            nonlocal logs
            new = []
            for at in range(0, len(missing), 20_000):
                some = ["▁" + w for w in missing[at : at + 20_000]]
                total = np.zeros((len(some), probability.shape[1]))
                for of in batches_of(some):
                    total[of] = forward([some[i] for i in of], prefixes, probability, fallback)
                new.append(total)
            for w in missing:
                index[w] = len(index)
            logs = np.concatenate([logs, *new])

        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                texts = part.column("__text").to_pylist()
                parts = [t.lower().split() if _LETTER.search(t) else [] for t in texts]
                missing = {w for p in parts for w in p if w not in index}
                if len(index) + len(missing) > KEPT_WORDS:
                    index.clear()
                    logs = logs[:0]
                    missing = {w for p in parts for w in p}
                if missing:
                    learn(list(missing))
                sizes = np.array([len(p) for p in parts])
                places = np.fromiter((index[w] for p in parts for w in p), np.int64, int(sizes.sum()))
                total = np.zeros((len(texts), probability.shape[1]))
                some = np.flatnonzero(sizes)
                if len(some):
                    total[some] = np.add.reduceat(logs[places], (np.cumsum(sizes) - sizes)[some])
                odds = np.exp(total - total.max(1, keepdims=True))
                best = total.argmax(1)
                sure = odds[np.arange(len(texts)), best] / odds.sum(1)
                real = (sizes > 0) & (len(langs) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"),
                        pa.array([langs[b] if ok else "und" for b, ok in zip(best, real)], pa.string()),
                        pa.array(np.where(real, sure, 0.0)),
                    ],
                    ["__id", "lang_pred", "score"],
                )

    out = rows.select("__id", "__text").mapInArrow(run, "__id long, lang_pred string, score double")
    return out.select(F.col("__id").alias(doc_id), (~is_training("__id", folds, held_out)).alias("held_out"), "lang_pred", "score")
