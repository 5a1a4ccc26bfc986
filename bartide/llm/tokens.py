"""Token counts by a whole-token shortcut.

The vocabulary strings that encode alone as one token are found once, on the driver, by running the merges on every one of
them. A pre-token that is such a string counts as one; only the others are merged. The proof holds for a whole pre-token
because merges never cross pre-tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import texts_of

VOCABULARY = "byte_bpe_50k.json"
#: pre-tokens that a worker remembers; beyond, it starts anew (memory, never the result)
MEMORY = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabularies of this kind: printable Latin-1 stands for itself,
    the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def vocabulary(path: str) -> tuple[dict[tuple[str, str], int], dict[str, int], tuple[str, ...]]:
    """(rank of each merge, id of each string, added strings), in the file's letters."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in whole["model"]["merges"]]
    return {m: i for i, m in enumerate(merges)}, whole["model"]["vocab"], tuple(t["content"] for t in whole["added_tokens"])


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens remain when the lowest-ranked, leftmost pair is merged until none is left."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    left = n
    gone = [False] * n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i] += symbols[j]
        gone[j] = True
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (k := before[i]) >= 0 and (p := (symbols[k], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[p], k, p))
    return left


def proven_single(path: str) -> frozenset[str]:
    """Vocabulary strings, as text, that the merges turn into one token. Strings that are not valid UTF-8 can't be a whole pre-token."""
    ranks, ids, _ = vocabulary(path)
    back = {c: b for b, c in byte_letters().items()}
    out = set()
    for word in ids:
        if all(c in back for c in word) and merged_length(list(word), ranks) == 1:
            try:
                out.add(bytes(back[c] for c in word).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return frozenset(out)


_remembered: dict[str, int] = {}


def count_batches(batches: Iterator[pa.RecordBatch], single: frozenset[str], path: str) -> Iterator[pa.RecordBatch]:
    ranks, _, added = vocabulary(path)
    letters = byte_letters()
    find = regex.compile(public_tokenizers.PATTERN).findall
    special = regex.compile("|".join(regex.escape(a) for a in added)) if added else None

    def rest(token: str) -> int:
        n = merged_length([letters[b] for b in token.encode("utf-8")], ranks)
        if len(_remembered) >= MEMORY:
            _remembered.clear()
        if len(token) < 200:
            _remembered[token] = n
        return n

    for batch in batches:
        n_bytes, n_tokens, n_merged = [], [], []
        for value in batch.column(1):
            text = value.as_py()
            count = merged = 0
            parts = special.split(text) if special else [text]
            for part in parts:
                found = find(part)
                others = [t for t in found if t not in single]
                count += len(found) - len(others)
                merged += len(others)
                for t in others:
                    count += _remembered.get(t) or rest(t)
            n_bytes.append(len(text.encode("utf-8")))
            n_tokens.append(count + len(parts) - 1)
            n_merged.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_merged, pa.int64())],
                                         names=["doc_id", "n_bytes", "n_tokens", "n_merged"])


def token_counts(docs: DataFrame, vocabulary_file: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_merged (pre-tokens outside the shortcut) of every whole text, one row per input row.

    A null or empty text has no tokens. Strings of special tokens inside a text are that one token. Narrow: no shuffle."""
    path = public_tokenizers.path(vocabulary_file)
    single = docs.sparkSession.sparkContext.broadcast(proven_single(path))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_batches(batches, single.value, path)

    counted = texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_merged long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_merged")
