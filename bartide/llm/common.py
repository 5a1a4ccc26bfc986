"""Helpers the text operators share: tables kept in the shared folder, joins with heavy keys, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bartide.session import shared_folder

#: bytes of text that are held as numpy arrays at a time (about sixty times as many bytes of memory)
PIECE_BYTES = 1 << 19
#: a key is heavy if it holds more than one row in so many; so there are never more heavy keys than this
HEAVY_SHARE = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The table written to the folder all executors share and read again: computed once, safe against lost executors,
    and read column by column. The files stay until that folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(docs: DataFrame) -> list[F.Column]:
    """All columns of a table, whatever dots their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """A name like `name` that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further columns of whatever name take no part; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def id_remainder(modulus: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def join_heavy(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on `key`, where `right` has one row for a key and the number of left rows in `count`.

    Keys with more than total / HEAVY_SHARE rows are at most HEAVY_SHARE many: they are listed on the driver and their rows of
    `right` broadcast, so that rows of one key are never gathered. All other keys are joined by shuffle. `right` should be
    a stored table: it is read twice."""
    limit = max(total // HEAVY_SHARE, 1)
    heavy = [r[0] for r in right.where((F.col(count) > limit) & F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    first = left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), key)
    return first.unionByName(left.where(~is_heavy).join(right.where(~is_heavy), key, how))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return places, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


@cache
def byte_tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte as it counts, whether it is white space). plain: as it is; lower: A-Z in lower case; letters: also ASCII marks are white space,
    and word_spans takes capitals of Latin-1 as small letters."""
    value, gap = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    if kind != "plain":
        value[65:91] += 32
    if kind == "letters":
        for low, high in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
            gap[low:high + 1] = True
    return value, gap


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, on a copy."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(gap: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """[start, end) in parts of PIECE_BYTES, each cut before white space; a longer word stays whole."""
    while end - start > PIECE_BYTES:
        near = np.flatnonzero(gap[start + 1:start + PIECE_BYTES])
        if len(near):
            stop = start + 1 + int(near[-1])
        else:
            far = np.flatnonzero(gap[start + PIECE_BYTES:end])
            if not len(far):
                break
            stop = start + PIECE_BYTES + int(far[0])
        yield start, stop
        start = stop
    yield start, end


def word_spans(data: np.ndarray, start: int, end: int, kind: str = "plain") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in data[start:end]; memory follows that length."""
    value, gap = byte_tables(kind)
    part = data[start:end]
    inside = np.concatenate(([False], ~gap[part], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), begins, ends
    size = 1 << max(20, int(len(part)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(part) + 1, np.uint64)
    part = value[part]
    if kind == "letters":
        part[1:][(part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)] += 0x20
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
    hashes = (total[ends] - total[begins]) * down[begins]
    return mixed(hashes ^ ((ends - begins).astype(np.uint64) << np.uint64(48))), begins + start, ends + start


def batch_words(column: pa.Array, kind: str = "plain", spans: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, word hash) of every word in an Arrow string array, in order; with spans also its first and last
    byte in the array's data. Works through pieces of bounded size, also inside a very long text."""
    places, data = text_buffers(column)
    gap = byte_tables(kind)[1]
    found: list[list[np.ndarray]] = [[], [], [], []]
    row, n = 0, len(places) - 1
    while row < n:
        stop = row
        while stop < n and places[stop + 1] - places[row] <= PIECE_BYTES:
            stop += 1
        stop = max(stop, row + 1)
        # texts touch each other in the data, so white space is put between them by hashing one long text alone
        if stop - row > 1:
            lengths = np.diff(places[row:stop + 1])
            apart = np.full(int(places[stop] - places[row]) + (stop - row), 0x20, np.uint8)
            shift = np.repeat(np.arange(stop - row), lengths)
            apart[np.arange(len(shift)) + shift] = data[places[row]:places[stop]]
            h, b, e = word_spans(apart, 0, len(apart), kind)
            local = np.searchsorted(places[row:stop + 1] - places[row] + np.arange(stop - row + 1), b, "right") - 1
            parts = [(local + row, h, b - local + places[row], e - local + places[row])]
        else:
            parts = []
            view = gap[data[places[row]:places[row + 1]]]
            for s, t in _cut(view, 0, len(view)):
                h, b, e = word_spans(data, int(places[row]) + s, int(places[row]) + t, kind)
                parts.append((np.full(len(h), row, np.int64), h, b, e))
        for part in parts:
            for have, new in zip(found, part):
                have.append(new)
        row = stop
    out = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.int64, np.uint64, np.int64, np.int64))]
    return tuple(out) if spans else (out[0], out[1])


def shingles(rows: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, number of the first word) of every window of `width` words; a text of fewer words has one window
    of all of them."""
    if not len(rows):
        return rows, hashes, rows
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    sizes = np.diff(np.append(starts, len(rows)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(rows))  # words from here to the end of the text
    padded = np.concatenate((hashes, np.zeros(width - 1, np.uint64)))
    value = np.zeros(len(rows), np.uint64)
    factor = 1
    for k in range(width):
        value += np.where(left > k, padded[k:k + len(rows)], np.uint64(0)) * np.uint64(factor)
        factor = factor * _BASE & _MASK
    keep = (left >= width) | ((np.arange(len(rows)) == np.repeat(starts, sizes)) & (np.repeat(sizes, sizes) < width))
    return rows[keep], mixed(value[keep]), np.flatnonzero(keep)


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text, bit by bit (DuckDB has no function for it)."""
    step = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step})"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda k: ascii(k)::BIGINT), lambda c, b: {byte}), 4294967295)"
