"""Benchmark decontamination by greedy string tiling.

Seeds are Karp-Rabin hashes of `min_tile` words. A text and a benchmark item that share a seed are tiled: equal runs of words
are found by extending the seeds along their diagonals, and the longest run that is not marked yet is marked in both, again
and again; what a marked run leaves of a longer one is a candidate as long as it has `min_tile` words. Tiles may stand in any
order, so passages whose sentences were moved are caught. A document is contaminated if the tiles cover enough of an item.

Texts are narrow work: each meets the benchmark in blocks of bounded size, one pass over the texts for each block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bartide.llm.common import _powers, batch_words, mixed, shingles, texts_of

MIN_TILE = 5
COVERAGE = 0.5
#: bytes of benchmark texts that a pass compares with all texts
BLOCK_BYTES = 8 << 20
#: equal places of a text and the items of a block that are listed at most; texts with more, such as loops of a few words, are tiled without a list
LISTED = 1 << 20


@dataclass
class Block:
    """Items of one block: their ids, words end to end, and the sorted seeds with the place of their first word."""
    ids: list[int]
    ends: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    places: np.ndarray
    min_tile: int


def block_of(items: list[tuple[int, str]], min_tile: int = MIN_TILE) -> Block:
    rows, hashes = batch_words(pa.array([t for _, t in items], pa.string()), "letters")
    _, seeds, first = shingles(rows, hashes, min_tile)
    order = np.argsort(seeds, kind="stable")
    return Block([i for i, _ in items], np.cumsum(np.bincount(rows, minlength=len(items))), hashes, seeds[order], first[order], min_tile)


def tiles(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], min_tile: int) -> list[tuple[int, int, int]]:
    """(place in text, place in item, length) of the tiles of two word sequences; `seeds` are all equal places (text, item) of min_tile words."""
    runs: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}  # of a diagonal: its last run
    for a, b in sorted(seeds):
        k = last.get(a - b)
        if k is not None and runs[k][0] + runs[k][2] - min_tile + 1 >= a:
            runs[k] = (runs[k][0], runs[k][1], a + min_tile - runs[k][0])
        else:
            last[a - b] = len(runs)
            runs.append((a, b, min_tile))
    runs = [(a, b, n) for a, b, n in runs if (text[a:a + n] == item[b:b + n]).all()]  # words themselves, not only seeds
    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    used_text: set[int] = set()
    used_item = np.zeros(len(item), bool)
    found = []
    while heap and not used_item.all():
        n, a, b = heapq.heappop(heap)
        free = [not used_item[b + k] and a + k not in used_text for k in range(-n)]
        if all(free):
            found.append((a, b, -n))
            used_item[b:b - n] = True
            used_text.update(range(a, a - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_tile:
                    heapq.heappush(heap, (start - k, a + start, b + start))
                start = None
    return found


class Windows:
    """Karp-Rabin values of the windows of any width of a word sequence, and which of its words are marked."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        size = 1 << max(20, int(len(words) + 1).bit_length())
        up, self._down = _powers(size)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)))
        self.used = np.zeros(len(words), bool)

    def free(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, value) of every window of `width` words without a marked one."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate(([0], np.cumsum(self.used)))
        at = np.flatnonzero(marked[width:] == marked[:n])
        return at, mixed((self._sums[at + width] - self._sums[at]) * self._down[at])


def longest_free_match(text: Windows, item: Windows, width: int) -> tuple[int, int] | None:
    """The first places of a free window of `width` words that both have."""
    b, values = item.free(width)
    a, own = text.free(width)
    if not len(b) or not len(a):
        return None
    order = np.argsort(values, kind="stable")
    values, b = values[order], b[order]
    low = np.searchsorted(values, own)
    low[low == len(values)] = 0
    for k in np.flatnonzero(values[low] == own):
        for j in range(low[k], np.searchsorted(values, own[k], "right")):  # items of one value stand in their order
            if (text.words[a[k]:a[k] + width] == item.words[b[j]:b[j] + width]).all():
                return int(a[k]), int(b[j])
    return None


def tiles_by_width(words: np.ndarray, item_words: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """The tiles of `tiles` without a list of equal places: the greatest width that free windows of both share is found by halving, its first match is
    marked, and so on with widths that never rise. Work follows the two lengths and the number of tiles, whatever repeats in them."""
    text, item = Windows(words), Windows(item_words)
    found: list[tuple[int, int, int]] = []
    width = min(len(words), len(item_words))
    while width >= min_tile:
        match = longest_free_match(text, item, width)
        if match is None:
            low, high = min_tile - 1, width - 1  # a match of `low` words exists, or none at all
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if longest_free_match(text, item, middle) else (low, middle - 1)
            width = low
            continue
        a, b = match
        found.append((a, b, width))
        text.used[a:a + width] = item.used[b:b + width] = True
    return found


def matches(column: pa.Array, block: Block) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, item, tiles, covered words, words of the item, longest tile) of every text and item that share a tile."""
    for start in range(0, len(column), 500):
        rows, hashes = batch_words(column.slice(start, 500), "letters")
        if not len(rows) or not len(block.seeds):
            continue
        _, seeds, first = shingles(rows, hashes, block.min_tile)
        low = np.searchsorted(block.seeds, seeds)
        low[low == len(block.seeds)] = 0
        hit = np.flatnonzero(block.seeds[low] == seeds)
        if not len(hit):
            continue
        low, high = low[hit], np.searchsorted(block.seeds, seeds[hit], "right")
        n = high - low
        begins = np.searchsorted(rows, np.arange(rows[-1] + 2))
        many = np.bincount(rows[first[hit]], n)[rows[first[hit]]] > LISTED
        for row in np.unique(rows[first[hit[many]]]).tolist():
            a, b = begins[row], begins[row + 1]
            own = np.unique(low[rows[first[hit]] == row])
            ends = np.searchsorted(block.seeds, block.seeds[own], "right")
            spots = np.concatenate([block.places[x:y] for x, y in zip(own, ends)])
            for which in np.unique(np.searchsorted(block.ends, spots, "right")).tolist():
                c, d = (block.ends[which - 1] if which else 0), block.ends[which]
                if d - c < block.min_tile and b - a != d - c:
                    continue  # a shorter item has one seed, of all its words
                found = tiles_by_width(hashes[a:b], block.words[c:d], min(block.min_tile, int(d - c)))
                if found:
                    yield row + start, which, len(found), sum(t[2] for t in found), int(d - c), max(t[2] for t in found)
        hit, low, n = hit[~many], low[~many], n[~many]
        if not len(hit):
            continue
        where = np.repeat(first[hit], n)
        spot = block.places[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        item = np.searchsorted(block.ends, spot, "right")
        pair = rows[where] * len(block.ids) + item
        order = np.argsort(pair, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            row, which = divmod(int(pair[part[0]]), len(block.ids))
            a, b = begins[row], begins[row + 1]
            c, d = (block.ends[which - 1] if which else 0), block.ends[which]
            width = min(block.min_tile, int(d - c))
            if width < block.min_tile and b - a != width:
                continue  # a shorter item has one seed, of all its words
            found = tiles(hashes[a:b], block.words[c:d], list(zip((where[part] - a).tolist(), (spot[part] - c).tolist())), width)
            if found:
                yield row + start, which, len(found), sum(t[2] for t in found), int(d - c), max(t[2] for t in found)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_tile: int = MIN_TILE) -> Iterator[Block]:
    """The benchmark in parts of about block_bytes, read one after the other; rows with a null id or text take no part."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    parts = -(-int(size[0] or 0) // block_bytes)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if rows:
            yield block_of([(r["item_id"], r["text"]) for r in rows], min_tile)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_tiles, covered_words, item_words, longest_tile, coverage of each text and item of which at least the
    share `coverage` is tiled; one row per pair of rows.

    Words are compared in lower case without ASCII marks. An item of fewer words than a tile matches a text that is equal to
    it. Null and empty texts match nothing."""
    out = None
    for block in blocks(benchmark, block_bytes, min_tile):
        part = texts_of(docs).mapInArrow(_pairs_of(block), "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, longest_tile int")
        out = part if out is None else out.union(part)
    if out is None:
        out = texts_of(docs).select("doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0).alias(c) for c in ("n_tiles", "covered_words", "item_words", "longest_tile")]).limit(0)
    share = F.col("covered_words") / F.col("item_words")
    return out.withColumn("coverage", share).where(F.col("coverage") >= coverage)


def _pairs_of(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(matches(batch.column(1), block))
            columns = list(zip(*found)) if found else [[]] * 6
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            items = pa.array([block.ids[i] for i in columns[1]], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, items, *[pa.array(c, pa.int32()) for c in columns[2:]]],
                                             names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "longest_tile"])
    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, with all columns, whose text is not contaminated. Narrow: a filter in each pass."""
    names, text = docs.columns, docs.columns.index("text")
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # a name with a dot could not be passed on
    for block in blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text).fill_null("")
                bad = {m[0] for m in matches(texts, block) if m[3] >= coverage * m[4]}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    return docs.toDF(*names)
