"""Language-model scores by a lattice of subwords.

A word is the string of its characters after a mark for its beginning, as in the public vocabulary. Every segmentation into
vocabulary pieces has a probability, the product of its pieces' and a stop; a forward recursion in log space sums all of them.
The pieces start with weights from the vocabulary's own scores; expectation maximisation over the different training
words then fits them. A word seen in training is one further arc over its whole span, weighted by its discounted share of
the training tokens; what the discount frees weights the lattice. So no word has probability 0.

Texts come from a mixture: each of the most frequent languages of the training texts, and all others together, has its own
pieces and word shares. A text's score is the log10 of the sum over these components of their share times the product over its
words and its end; the language of the scored text itself is not looked at.

Word counts stay a distributed table. The most frequent words, a bounded number, are scored where the texts are; the others
are joined with that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import batch_words, id_remainder, mixed, stored, text_buffers

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
#: words whose values are sent to every task, at most
NEAR_WORDS = 1 << 19
#: components of the mixture, at most
COMPONENTS = 8
#: words that are worked on together
WORDS_AT_ONCE = 20_000
#: texts whose words are held as arrays together
TEXTS_AT_ONCE = 2000
#: longer words go through the recursion one by one
LONG = 40
#: expected count that every piece has without being seen
PRIOR = 0.01
BEGIN = 0x2581
_STEP = np.uint64(0x100000001B3)


@dataclass
class Pieces:
    """Sorted hashes of the pieces with their log weights; stop and byte are log weights of a word's end and of one byte of a
    character outside the vocabulary."""
    hashes: np.ndarray
    weights: np.ndarray  # components x pieces
    stop: np.ndarray     # of each component, as the next
    byte: np.ndarray
    longest: int


@cache
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, scores, longest piece) of all pieces that are text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    longest = 1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _STEP + np.uint64(ord(c))
        found[int(mixed(h)[0])] = model.get_score(i)
        longest = max(longest, len(piece))
    hashes = np.array(sorted(found), np.uint64)
    return hashes, np.array([found[int(h)] for h in hashes]), longest


_slots: dict[tuple[int, int, int], np.ndarray] = {}
_SLOT_BITS = 21


def places_of(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted hashes, -1 if it is none. A slot table answers nearly all keys at once; only keys of
    slots that several hashes share are searched."""
    if not len(hashes):
        return np.full(len(keys), -1)
    name = (len(hashes), int(hashes[0]), int(hashes[-1]))
    table = _slots.get(name)
    mask = np.uint64((1 << _SLOT_BITS) - 1)
    if table is None:
        slot = (hashes & mask).astype(np.int64)
        table = np.full(1 << _SLOT_BITS, -1, np.int32)
        table[slot] = np.arange(len(hashes))
        table[np.bincount(slot, minlength=1 << _SLOT_BITS) > 1] = -2
        _slots.clear()
        _slots[name] = table
    place = table[(keys & mask).astype(np.int64)]
    several = np.flatnonzero(place == -2)
    if len(several):
        place[several] = np.minimum(np.searchsorted(hashes, keys[several]), len(hashes) - 1)
    place[hashes[place] != keys] = -1
    return place


def initial(path: str, components: int = 1) -> Pieces:
    """Weights from the vocabulary's scores: minus the rank of a piece, taken by Zipf's law; the same in each component."""
    hashes, scores, longest = _vocabulary(path)
    weight = 1 / (10 - np.maximum(scores, -1e6))
    total = weight.sum() * 1.6
    return Pieces(hashes, np.tile(np.log(weight / total), (components, 1)), np.full(components, math.log(0.3)), np.full(components, math.log(1e-3 / 256)), longest)


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _arcs(points: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(from, to, words that have the arc, their pieces) over the columns of equally long words; without pieces: a character
    outside the vocabulary. Arcs come in order of their beginnings."""
    n, length = points.shape
    for i in range(length):
        h = np.zeros(n, np.uint64)
        for j in range(i + 1, min(i + pieces.longest, length) + 1):
            h = h * _STEP + points[:, j - 1]
            place = places_of(pieces.hashes, mixed(h))
            some = np.flatnonzero(place >= 0)
            if len(some):
                yield i, j, some, place[some]
            if j == i + 1 and len(some) < n:
                yield i, j, np.flatnonzero(place < 0), None


def _weights(points: np.ndarray, pieces: Pieces, i: int, rows: np.ndarray, place: np.ndarray | None) -> np.ndarray:
    """Log weights of an arc, components x words."""
    if place is None:
        return pieces.byte[:, None] * _utf8_size(points[rows, i])[None, :]
    return pieces.weights[:, place]


def _long_arcs(word: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(from, pieces of the arcs to the next places or -1, their log weights: components x places) along one word."""
    sizes = _utf8_size(word)
    for i in range(len(word)):
        span = word[i:i + pieces.longest]
        h, keys = np.uint64(0), np.zeros(len(span), np.uint64)
        with np.errstate(over="ignore"):
            for k, c in enumerate(span):
                h = h * _STEP + c
                keys[k] = h
        place = places_of(pieces.hashes, mixed(keys))
        step = np.where((place >= 0)[None, :], pieces.weights[:, place], -np.inf)
        if place[0] < 0:
            step[:, 0] = sizes[i] * pieces.byte
        yield i, place, step


def _long_word(word: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The forward recursion of one word: log probability of its first characters, components x places."""
    alpha = np.full((len(pieces.stop), len(word) + 1), -np.inf)
    alpha[:, 0] = 0.0
    for i, place, step in _long_arcs(word, pieces):
        ahead = slice(i + 1, i + 1 + len(place))
        alpha[:, ahead] = np.logaddexp(alpha[:, ahead], alpha[:, i:i + 1] + step)
    return alpha


def _long_counts(word: np.ndarray, seen: np.ndarray, pieces: Pieces, counts: np.ndarray, other: np.ndarray) -> None:
    """Add the expected counts of one long word, times `seen`: forward and backward in log space, because the probability of a
    long word is no number a double can hold. The arcs are found again on the way back instead of being kept."""
    alpha = _long_word(word, pieces)
    length, size = len(word), _utf8_size(word)
    beta = np.full(alpha.shape, -np.inf)
    beta[:, length] = 0.0
    for i, place, step in _backwards(word, pieces):
        ahead = slice(i + 1, i + 1 + len(place))
        after = step + beta[:, ahead]
        top = after.max(axis=1)
        beta[:, i] = np.where(np.isfinite(top), top + np.log(np.exp(after - np.where(np.isfinite(top), top, 0)[:, None]).sum(axis=1)), -np.inf)
        expected = np.exp(np.minimum(alpha[:, i:i + 1] + after - alpha[:, length:], 0)) * seen[:, None]
        known = place >= 0
        for c in range(len(counts)):
            np.add.at(counts[c], place[known], expected[c, known])
        if place[0] < 0:
            other += expected[:, 0] * size[i]


def _backwards(word: np.ndarray, pieces: Pieces, part: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The arcs of a very long word from its end on; those of one part are held at a time."""
    for start in range((len(word) - 1) // part * part, -1, -part):
        own = [a for a in _long_arcs(word[start:start + part + pieces.longest - 1], pieces) if a[0] < part]
        yield from ((start + i, place, step) for i, place, step in reversed(own))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, code points with the beginning mark) of words of equal length, some at a time."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        numbers = np.flatnonzero(lengths == length)
        step = max(WORDS_AT_ONCE * 10 // (int(length) + 1), 1)
        for k in range(0, len(numbers), step):
            own = numbers[k:k + step]
            rows = np.full((len(own), int(length) + 1), BEGIN, np.uint64)
            rows[:, 1:] = points[begins[own][:, None] + np.arange(int(length))]
            yield own, rows


def word_scores(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural log of the probability of each word over all its segmentations, components x words."""
    out = np.zeros((len(pieces.stop), len(words)))
    for numbers, points in _by_length(words):
        length = points.shape[1]
        if length > LONG:
            for number, word in zip(numbers, points):
                out[:, number] = _long_word(word, pieces)[:, -1]
            continue
        alpha = np.full((length + 1, len(pieces.stop), len(points)), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, place in _arcs(points, pieces):
            alpha[j][:, rows] = np.logaddexp(alpha[j][:, rows], alpha[i][:, rows] + _weights(points, pieces, i, rows, place))
        out[:, numbers] = alpha[length]
    return out + pieces.stop[:, None]


def expected_counts(words: list[str], seen: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(expected count of each piece, expected bytes outside the vocabulary) in each component, over one occurrence of each word
    that `seen` (components x words) has there. Plain probabilities of short words are far from underflow; words longer than LONG are taken one by
    one in log space."""
    k = len(pieces.stop)
    counts, other = np.zeros(pieces.weights.shape), np.zeros(k)
    for numbers, points in _by_length(words):
        length = points.shape[1]
        if length > LONG:
            for number, word in zip(numbers, points):
                _long_counts(word, seen[:, number], pieces, counts, other)
            continue
        arcs = [(i, j, rows, place, np.exp(_weights(points, pieces, i, rows, place))) for i, j, rows, place in _arcs(points, pieces)]
        alpha, beta = (np.zeros((length + 1, k, len(points))) for _ in range(2))
        alpha[0] = beta[length] = 1.0
        for i, j, rows, _, weight in arcs:
            alpha[j][:, rows] += alpha[i][:, rows] * weight
        for i, j, rows, _, weight in reversed(arcs):
            beta[i][:, rows] += weight * beta[j][:, rows]
        share = seen[:, numbers] / np.maximum(alpha[length], 1e-300)
        for i, j, rows, place, weight in arcs:
            expected = alpha[i][:, rows] * weight * beta[j][:, rows] * share[:, rows]
            if place is None:
                other += (expected * _utf8_size(points[rows, i])).sum(axis=1)
            else:
                for c in range(k):
                    counts[c] += np.bincount(place, expected[c], minlength=counts.shape[1])
    return counts, other


def refitted(pieces: Pieces, counts: np.ndarray, other: np.ndarray, words: np.ndarray) -> Pieces:
    total = counts.sum(axis=1) + PRIOR * counts.shape[1] + other + 1 + words + 1
    return Pieces(pieces.hashes, np.log((counts + PRIOR) / total[:, None]), np.log((words + 1) / total), np.log((other + 1) / total / 256), pieces.longest)


def _word_counts(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[pa.RecordBatch]:
    """Words of each batch with their occurrences in all texts and in the training texts of each component. Columns doc_id, text,
    component (-1: held out)."""
    for batch in batches:
        found: list[tuple] = []
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            rows, hashes, begins, ends = batch_words(part.column(1), "lower", spans=True)
            component = part.column(2).to_numpy(zero_copy_only=False)[rows]
            unique, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            counts = [np.bincount(of, minlength=len(first)), *[np.bincount(of[component == k], minlength=len(first)) for k in range(components)]]
            found.append((unique, np.stack(counts), _texts(part.column(1), begins[first], ends[first])))
            del rows, hashes, begins, ends, component, of
        hashes, first, of = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        words = [w for f in found for w in f[2]]
        words = [words[i] for i in first]
        parts = np.concatenate([f[1] for f in found], axis=1)
        counts = [np.bincount(of, p, minlength=len(first)).astype(np.int64) for p in parts]
        for k in range(0, len(first), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.string()), pa.array(hashes[part].view(np.int64)), *[pa.array(c[part]) for c in counts]],
                                             names=["word", "hash", "n", *[f"c{i}" for i in range(components)]])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _texts(column: pa.Array, begins: np.ndarray, ends: np.ndarray) -> list[str]:
    if not len(begins):
        return []
    low = int(begins.min())
    data = text_buffers(column)[1][low:int(ends.max())].tobytes().translate(_LOWER)
    begins, ends = begins - low, ends - low
    return [data[b:e].decode("utf-8", "replace") for b, e in zip(begins.tolist(), ends.tolist())]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches put together to at least `rows` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _seen(table: pa.Table, components: int) -> np.ndarray:
    """Training occurrences of each word, components x words."""
    return np.stack([table[f"c{k}"].to_numpy() for k in range(components)]).astype(float)


def fitted(words: DataFrame, path: str, components: int = 1, rounds: int = ROUNDS) -> Pieces:
    """Pieces after some rounds of expectation maximisation over the different training words. At most the vocabulary, once for
    each component, reaches the driver."""
    pieces = initial(path, components)
    names = [f"c{k}" for k in range(components)]
    seen = words.where(" or ".join(f"{c} > 0" for c in names)).select("word", *names)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            counts, other, n = np.zeros(pieces.weights.shape), np.zeros(components), np.zeros(components)
            for table in _gathered(batches):
                own = (_seen(table, components) > 0).astype(float)
                part, more = expected_counts(table["word"].to_pylist(), own, pieces)
                counts, other, n = counts + part, other + more, n + own.sum(axis=1)
            component, piece = np.nonzero(counts)
            every = np.arange(components)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((component, every, every)), pa.int32()), pa.array(np.concatenate((piece, np.full(components, -1), np.full(components, -2))), pa.int32()),
                                              pa.array(np.concatenate((counts[component, piece], other, n)))], names=["component", "piece", "expected"])

        sums = seen.mapInArrow(run, "component int, piece int, expected double").groupBy("component", "piece").agg(F.sum("expected").alias("expected")).toArrow()
        component, piece, expected = (sums[c].to_numpy() for c in ("component", "piece", "expected"))
        sizes = [np.bincount(component[piece == k], expected[piece == k], minlength=components) for k in (-1, -2)]
        if not sizes[1].sum():
            break
        counts = np.zeros(pieces.weights.shape)
        own = piece >= 0
        counts[component[own], piece[own]] = expected[own]
        pieces = refitted(pieces, counts, sizes[0], sizes[1])
    return pieces


def lm_scores(docs: DataFrame, vocabulary_file: str = VOCABULARY, rounds: int = ROUNDS, near_words: int = NEAR_WORDS, component: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per input row.

    Tokens are the words of the whole text, A-Z in lower case, and one end. Texts whose crc32(doc_id) mod 7 is 2 are held
    out of all counts. A null or empty text is only its end. `component` names the column whose values part the training
    texts; nulls and rare values share a component, as all do if there is no such column. Without training texts every word
    is scored by the vocabulary's own weights."""
    path = public_tokenizers.path(vocabulary_file)
    kind = F.coalesce(F.col(component).cast("string"), F.lit("")) if component in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), kind.alias("kind"))
    train = id_remainder(7) != 2
    common = texts.where(train).groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(COMPONENTS - 1).collect()
    place = F.lit(len(common))
    for i, r in enumerate(common):
        place = F.when(F.col("kind") == r["kind"], i).otherwise(place)
    number = len(common) + 1  # the last one takes the rest
    texts = texts.select("doc_id", "text", F.when(train, place).otherwise(-1).cast("int").alias("component"))

    names = [f"c{k}" for k in range(number)]
    counted = texts.mapInArrow(lambda b: _word_counts(b, number), "word string, hash long, n long, " + ", ".join(f"{c} long" for c in names))
    words = stored(counted.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]))
    pieces = fitted(words, path, number, rounds)

    ends = np.zeros(number)
    for r in texts.where("component >= 0").groupBy("component").count().collect():
        ends[r["component"]] = r["count"]
    whole = " + ".join(names)
    found = words.agg(F.sum(F.expr(f"cast({whole} > 0 as long)")), *[F.sum(F.expr(f"cast({what} as long)")) for c in names for what in (c, f"{c} > 0", f"{c} = 1", f"{c} = 2")]).first()
    tokens, distinct, once, twice = np.array([int(x or 0) for x in found[1:]], float).reshape(number, 4).T
    total, kinds = int(tokens.sum() + ends.sum()), int(found[0] or 0) + int(ends.sum() > 0)
    off = math.log10(total + kinds + 1)
    totals = np.maximum(tokens + ends, 2)
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
    escape = np.where(distinct > 0, discount * distinct / totals, 0.5)
    end_scores = np.log10(np.maximum(ends, 1) / totals)
    prior = np.log10((ends + 0.01) / (ends.sum() + 0.01 * number))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns word, hash, n and the counts."""
        for table in _gathered(batches):
            c = _seen(table, number)
            lattice = word_scores(table["word"].to_pylist(), pieces) + np.log(escape)[:, None]
            with np.errstate(divide="ignore"):
                own = np.where(c > 0, np.log(np.maximum(c - discount[:, None], 1e-9) / totals[:, None]), -np.inf)
            scores = np.logaddexp(lattice, own) / math.log(10)
            yield pa.RecordBatch.from_arrays([table["hash"].combine_chunks(), table["n"].combine_chunks(), pa.array(c.sum(axis=0).astype(np.int64)), *[pa.array(s.astype(np.float32)) for s in scores]],
                                             names=["hash", "n", "c", *scores_of])

    scores_of = [f"s{k}" for k in range(number)]
    values = stored(words.select("word", "hash", "n", *names).mapInArrow(valued, "hash long, n long, c long, " + ", ".join(f"{s} float" for s in scores_of)))
    # the least count that at most near_words words reach
    sizes = sorted(values.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"])  # at most sqrt(2 x tokens) counts
    least, taken = (sizes[0]["n"] + 1 if sizes else 1), 0
    for r in sizes:
        taken += r["words"]
        if taken > near_words:
            break
        least = r["n"]
    near = values.where(F.col("n") >= least).drop("n").toArrow()
    keys = near["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = near["c"].to_numpy()[order]
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], counts, np.stack([near[s].to_numpy()[order] for s in scores_of])))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over its near words (hash null), and one for each other word in it."""
        keys, counts, scores = shared.value
        row_id = TaskContext.get().partitionId() << 40
        sums_of = ["base", "known", *scores_of]
        for batch in (b.slice(k, TEXTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows, hashes = batch_words(batch.column(1), "lower")
            n = batch.num_rows
            ids = np.arange(row_id, row_id + n)
            row_id += n
            place = np.searchsorted(keys, hashes)
            place[place == len(keys)] = 0
            hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
            at, place = rows[hit], place[hit]
            sums = [np.bincount(at, v, minlength=n) for v in (np.log10(counts[place] + 1.0), counts[place] > 0, *[s[place] for s in scores])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), pa.nulls(n, pa.int64()), pa.array(np.bincount(rows, minlength=n), pa.int64()), *[pa.array(s, pa.float64()) for s in sums]],
                                             names=["row", "doc_id", "hash", "times", *sums_of])
            far, kinds_of = np.unique(hashes[~hit], return_inverse=True)
            pairs, times = np.unique(rows[~hit] * max(len(far), 1) + kinds_of, return_counts=True)
            m = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // max(len(far), 1)]), pa.nulls(m, pa.int64()), pa.array(far[pairs % max(len(far), 1)].view(np.int64)), pa.array(times, pa.int64()),
                                              *[pa.nulls(m, pa.float64())] * len(sums_of)], names=["row", "doc_id", "hash", "times", *sums_of])

    schema = "row long, doc_id long, hash long, times long, base double, known double, " + ", ".join(f"{s} double" for s in scores_of)
    rows = stored(texts.select("doc_id", "text").mapInArrow(summed, schema))
    others = rows.where("hash is not null").select("row", "hash", "times")
    joined = others.join(values.where(F.col("n") < least).drop("n"), "hash")
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(F.col("times") * (F.col("c") > 0).cast("double")).alias("more_known"),
                                     *[F.sum(F.col("times") * F.col(s)).alias(f"more_{s}") for s in scores_of])
    both = rows.where("hash is null").join(rest, "row", "left").fillna(0.0, ["more_base", "more_known", *[f"more_{s}" for s in scores_of]])
    n_tokens = F.col("times") + 1
    n_known = F.round(F.col("known") + F.col("more_known")).cast("long") + (1 if ends.sum() else 0)
    base = F.col("base") + F.col("more_base") + math.log10(ends.sum() + 1) - n_tokens * off
    of_component = [F.col(s) + F.col(f"more_{s}") + float(end_scores[k] + prior[k]) for k, s in enumerate(scores_of)]
    both = both.withColumn("best", F.greatest(*of_component) if number > 1 else of_component[0])
    score = F.col("best") + F.log10(sum(F.pow(F.lit(10.0), s - F.col("best")) for s in of_component))
    return both.select("doc_id", (id_remainder(7) == 2).alias("held_out"), n_tokens.alias("n_tokens"), n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                       base.alias("base_score"), score.alias("score"))
