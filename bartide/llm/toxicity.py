"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is whether an n-gram inside a word (with a blank for each word end) occurs in the text. Document counts of all n-grams
are taken over a bounded sample of labelled rows; the n-grams whose shares in the two classes differ most become features,
scaled by the log ratio of their smoothed shares; a logistic regression is fitted on them. All texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import batch_words, id_remainder, mixed, text_buffers, texts_of

#: most labelled rows used for fitting; rows of the lowest id hash are taken
SAMPLE_ROWS = 20_000
#: most n-grams used as features
FEATURES = 4096
#: standard errors by which the shares of the two classes must differ
LEAST_Z = 4.0
LENGTHS = (2, 3, 4, 5, 6)
THRESHOLD = 0.3


@dataclass
class Model:
    grams: np.ndarray    # sorted hashes of the n-grams in use
    weights: np.ndarray  # coefficient times log-count ratio of each
    intercept: float


def word_grams(column: pa.Array, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, n-gram hash) of the words at these bytes; an n-gram may begin or end with the blank at a word end."""
    _, data = text_buffers(column)
    lengths = ends - begins
    total = int(lengths.sum())
    out = np.full(total + len(begins) + 1, 0x20, np.uint8)
    number = np.repeat(np.arange(len(begins)), lengths)
    inside = np.arange(total)
    out[inside + number + 1] = data[inside - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins, lengths)]
    points = np.frombuffer(out.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = points == 0x20
    word = np.cumsum(blank) - 1  # of a character; a blank counts to the word after it
    words, hashes = [], []
    gaps = np.concatenate(([0], np.cumsum(blank)))
    for n in LENGTHS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        inner = gaps[n - 1:n - 1 + size] - gaps[1:1 + size] == 0 if n > 2 else ~(blank[:size] & blank[1:1 + size])
        at = np.flatnonzero(inner)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + points[at + k]
        words.append(word[at])
        hashes.append(mixed(value))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(words), np.concatenate(hashes)


def present(column: pa.Array, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash; with `grams` its place there) of every different n-gram of each text, or of those in `grams`."""
    texts, values = [], []
    for start in range(0, len(column), 500):
        part = column.slice(start, 500)
        rows, hashes, begins, ends = batch_words(part, "lower", spans=True)
        if not len(rows):
            continue
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        word, gram = word_grams(part, begins[first], ends[first])
        if grams is not None:
            place = np.searchsorted(grams, gram)
            place[place == len(grams)] = 0
            hit = grams[place] == gram if len(grams) else np.zeros(len(gram), bool)
            word, gram = word[hit], place[hit]
        order = np.argsort(word, kind="stable")
        word, gram = word[order], gram[order]
        counts = np.bincount(word, minlength=len(first))
        kept = counts[of] > 0
        pairs = np.unique(rows[kept] * len(first) + of[kept])
        row, own = pairs // len(first), pairs % len(first)
        begin = np.cumsum(counts) - counts
        n = counts[own]
        index = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row, gram = np.repeat(row, n), gram[index]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))) if len(row) else np.zeros(0, bool)
        texts.append(row[new] + start)
        values.append(gram[new])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64 if grams is None else np.int64)
    return np.concatenate(texts), np.concatenate(values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.asarray(batch.column(2).to_pylist(), bool)
        row, gram = present(batch.column(1))
        found, of = np.unique(gram, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(of[toxic[row]], minlength=len(found)), pa.int64()),
                                          pa.array(np.bincount(of[~toxic[row]], minlength=len(found)), pa.int64())], names=["gram", "toxic", "clean"])


def logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, labels: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the intercept: full-batch descent with momentum on the penalised log loss."""
    n = len(labels)
    values = scale[columns]
    beta, bias = np.zeros(len(scale)), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    curve = 0.25 * np.bincount(columns, values ** 2, minlength=len(scale)) + penalty  # bound of each diagonal entry of the Hessian
    width = max(np.bincount(rows, minlength=n).max(initial=1), 1)
    step = 1.0 / (curve * np.sqrt(width))
    last, last_bias = beta.copy(), bias
    for k in range(rounds):
        momentum = k / (k + 3)
        look, look_bias = beta + momentum * (beta - last), bias + momentum * (bias - last_bias)
        margin = np.bincount(rows, values * look[columns], minlength=n) + look_bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        last, last_bias = beta, bias
        beta = look - step * (np.bincount(columns, values * error[rows], minlength=len(scale)) + penalty * look)
        bias = look_bias - 4 * error.sum() / n / np.sqrt(width)
    return beta, bias


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """The classifier of at most `sample_rows` labelled rows outside the held-out quarter. With one class or no labels it has
    only an intercept. What reaches the driver is bounded by sample_rows x features places."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").where(id_remainder(4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = texts_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", (F.col("toxic") == 1).alias("toxic"))  # sample_rows ids at most
    counts = rows.mapInArrow(_count, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = int(sizes["toxic"]), int(sizes["n"] - sizes["toxic"])
    prior = float(np.log((n_toxic + 1) / (n_clean + 1)))
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)
    share = F.expr(f"(toxic + clean) / {n_toxic + n_clean}D")
    z = F.abs(F.expr(f"toxic / {n_toxic}D - clean / {n_clean}D")) / F.sqrt(share * (1.0000001 - share) * (1 / n_toxic + 1 / n_clean))
    best = counts.select("gram", "toxic", "clean", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "gram").limit(features).collect()
    if not best:
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)
    best = sorted(((np.int64(r["gram"]).view(np.uint64), r["toxic"], r["clean"]) for r in best), key=lambda r: int(r[0]))
    grams = np.array([r[0] for r in best], np.uint64)
    toxic, clean = (np.array([r[i] for r in best], float) for i in (1, 2))
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place = present(batch.column(1), grams)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["doc_id", "toxic", "places"])

    table = rows.mapInArrow(places, "doc_id long, toxic boolean, places array<int>").orderBy("doc_id").toArrow()
    target = table["toxic"].to_numpy().astype(float)
    lists = table["places"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    beta, bias = logistic(np.repeat(np.arange(len(target)), sizes), lists.flatten().to_numpy(), ratio, target)
    return Model(grams, beta * ratio, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row per input row; null and empty texts get the score of a
    text without features. Narrow: no shuffle; the model is bounded by FEATURES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.full(batch.num_rows, model.intercept)
            if len(model.grams):
                row, place = present(batch.column(1), model.grams)
                margin += np.bincount(row, model.weights[place], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels))
