"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is encoded by itself. A segment tree over its byte positions keeps the leftmost pair of
the lowest rank; a merge changes two neighbouring pairs and removes one, each a logarithmic point update.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: matches in each of the two generations that a worker remembers (memory, never the result)
MEMORY = 200_000
#: texts whose ids are held together
TEXTS_AT_ONCE = 1000
_NONE = 1 << 62


@cache
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


@cache
def byte_table(path: str) -> dict[str, bytes]:
    return {str(i): word for word, i in rank_table(path).items()}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. A piece that is in the table is that one id; else the leftmost pair of lowest rank is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    # a leaf is rank * size + position, so the smallest is the lowest rank and, within it, the leftmost
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (r := ranks.get(piece[i:i + 2])) is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))     # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part to the left starts

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    while tree[1] < _NONE:
        i = tree[1] % size
        j = end[i]
        stop = end[i] = end[j]
        put(j, _NONE)
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i:end[stop]])
            put(i, _NONE if r is None else r * size + i)
        else:
            put(i, _NONE)
        if (k := before[i]) >= 0:
            r = ranks.get(piece[k:stop])
            put(k, _NONE if r is None else r * size + k)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


_young: dict[str, str] = {}
_old: dict[str, str] = {}


def _looked_up(token: str, ranks: dict[bytes, int]) -> str:
    """Ids of a match that the young generation does not hold. What is met again moves there, so that frequent matches stay
    when the old generation is given up."""
    got = _old.get(token)
    if got is None:
        got = ",".join(map(str, encode_piece(token.encode("utf-8"), ranks)))
    if len(_young) >= MEMORY:
        _old.clear()
        _old.update(_young)
        _young.clear()
    if len(token) < 200:
        _young[token] = got
    return got


def encode_text(text: str, ranks: dict[bytes, int], find) -> str:
    """Decimal ids joined by commas."""
    get = _young.get
    return ",".join([get(token) or _looked_up(token, ranks) for token in find(text)])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    ranks, back = rank_table(path), byte_table(path)
    find = regex.compile(public_tokenizers.PATTERN).findall
    for batch in (b.slice(k, TEXTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
        counts, ids_out, ids_sha, decoded_sha = [], [], [], []
        for value in batch.column(1):
            joined = encode_text(value.as_py(), ranks, find)
            ids = joined.split(",") if joined else []
            decoded = b"".join([back[i] for i in ids])
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:  # four bytes an id: as objects they would be many times the text
                ids_out.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(counts)))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids_out))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encoded(docs: DataFrame, rank_file: str = RANKS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every whole text, one row per input row.

    A null or empty text has no ids. Special tokens are ordinary text. Narrow: no shuffle."""
    path = public_tokenizers.path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_batches(batches, path, with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return texts_of(docs).mapInArrow(run, schema)


def decoded(frame: DataFrame, rank_file: str = RANKS) -> DataFrame:
    """doc_id, data (binary) of a table with doc_id and ids: the bytes the ids stand for. A null list decodes to nothing."""
    path = public_tokenizers.path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = byte_table(path)
        for batch in batches:
            data = [b"".join([back[str(i)] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return frame.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, data binary")
