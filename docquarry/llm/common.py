"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text hashed at a time; longer runs are cut at white space.
SEGMENT = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def is_training(column: str, folds: int, held_out: int):
    """Rows whose crc32 of the id's decimal text is not ``held_out`` modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held_out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64; the tables of one segment are kept."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        base = int(_PRIME) | 1
        step = np.full(size, base, np.uint64)
        step[0] = 1
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        tables = np.cumprod(step), np.cumprod(back)
        if size > 4 * SEGMENT:
            return tables
        _powers[size] = tables
    return _powers[size]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n + 1 offsets into them (null: empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than 9 to 13 and 32), and words per text."""
    hashes, counts, _, _ = word_places(*text_buffers(texts))
    return hashes, counts


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, words per text, and where each word begins and stops in ``data``."""
    found, starts, stops, at = [], [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):  # go on to white space or to the end of this text
            limit = cuts[np.searchsorted(cuts, end)]
            step = end
            while step < limit:
                blank = np.flatnonzero(_SPACE[data[step : min(step + SEGMENT, limit)]])
                if len(blank):
                    limit = step + blank[0]
                    break
                step += SEGMENT
            end = limit
        part = data[at:end]
        solid = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        inner = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end, "right")] - at
        edge[inner] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        forth, back = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * forth[: len(part)], out=total[1:])
        found.append(mix((total[stop] - total[begin]) * back[begin]))
        starts.append(begin + at)
        stops.append(stop + at)
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(cuts) - 1, np.int64), none, none
    start = np.concatenate(starts)
    return np.concatenate(found), np.diff(np.searchsorted(start, cuts)), start, np.concatenate(stops)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions near the end are cut off)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, power, width, have = None, 0, words, 1, k
    factor = int(_PRIME) | 1
    while have:
        if have & 1:
            part = power[taken : taken + n]
            out = part.copy() if out is None else out * np.uint64(pow(factor, width, 1 << 64)) + part
            taken += width
        have >>= 1
        if have:
            power = power[:-width] * np.uint64(pow(factor, width, 1 << 64)) + power[width:]
            width *= 2
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; a text is never cut."""
    if not batch.num_rows:
        return
    _, cuts = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; only the last group is held back."""
    held: list[pa.RecordBatch] = []
    held_rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_rows += batch.num_rows
        if held_rows < rows:
            continue
        whole = pa.Table.from_batches(held)
        same = np.ones(whole.num_rows, bool)
        for key in keys:
            values = whole.column(key).to_numpy()
            same &= values == values[-1]
        change = np.flatnonzero(~same)
        if not len(change):
            held = whole.to_batches()
            continue
        cut = int(change[-1]) + 1
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        held_rows = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def group_ids(*columns: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each run of equal rows of sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def digests_of(values) -> list[str]:
    import hashlib

    return [hashlib.sha256(v).hexdigest() for v in values]
