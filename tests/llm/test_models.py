"""The toxicity classifier and the lattice scores: held-out accuracy and plain-Python versions."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from bartide.llm import lattice, toxicity
from tests.llm.corpus import awkward, frame, words


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    bad = ["zorkle", "quimpf", "vexbag"]
    docs, labels = [], []
    for i in range(1500):
        body = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        mark = i % 8 == 0
        if mark:
            for _ in range(rng.randrange(1, 4)):
                body.insert(rng.randrange(len(body)), rng.choice(bad).upper() if i % 3 else rng.choice(bad) + "s")
        docs.append((i, " ".join(body)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(mark)))
    return docs, labels


def test_held_out_accuracy(spark, toxic):
    docs, labels = toxic
    extra = [(5000, None), (5001, ""), (5002, "zorkle " * 20_000), (None, "an")]
    rows = toxicity.toxicity(frame(spark, docs + extra), spark.createDataFrame(labels + [(None, 1), (4, None), (8, 1), (8, 1)], "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) + len(extra)
    by = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 300
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert by[5000].predicted == by[5001].predicted == 0 and by[5002].predicted == 1


def test_one_class_no_labels_no_rows(spark, toxic):
    docs = frame(spark, toxic[0][:20])
    for labels in ([], [(1, 0), (3, 0)], [(1, 1)]):
        rows = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(rows) == 20 and len({r.score for r in rows}) == 1
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")).count() == 0


def test_grams_stay_inside_words():
    import pyarrow as pa

    column = pa.array(["ab  É cd", "", "ab"])
    row, gram = toxicity.present(column)
    again, other = toxicity.present(pa.array(["cd é AB"]))
    assert set(gram[row == 0].tolist()) == set(other.tolist()) and not (row == 1).any()
    # ' ab ', ' é ', ' cd ' have 3 + 2 + 1, 2 + 1 and 3 + 2 + 1 n-grams of two and more characters
    assert (row == 0).sum() == 6 + 3 + 6 and set(gram[row == 2].tolist()) <= set(gram[row == 0].tolist())


def brute_word(word, pieces, k=0):
    """Log probability by listing every segmentation."""
    known = dict(zip(pieces.hashes.tolist(), pieces.weights[k].tolist()))
    text = "▁" + word
    total = -math.inf
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(text[start:i])
                start = i
        weight = 0.0
        for p in parts:
            h = np.zeros(1, np.uint64)
            for ch in p:
                h = h * lattice._STEP + np.uint64(ord(ch))
            found = known.get(int(lattice.mixed(h)[0]))
            if found is None:
                found = len(p.encode()) * pieces.byte[k] if len(p) == 1 else -math.inf
            weight += found
        total = np.logaddexp(total, weight)
    return total + pieces.stop[k]


@pytest.fixture(scope="module")
def pieces():
    return lattice.initial(public_tokenizers.path(lattice.VOCABULARY), 2)


def test_forward_recursion(pieces, monkeypatch):
    sample = ["the", "a", "thering", "é", "日本", "x<y", "\U0001F600z", "of,"]
    scores = lattice.word_scores(sample, pieces)
    for i, w in enumerate(sample):
        assert scores[0, i] == pytest.approx(brute_word(w, pieces), rel=1e-9) and scores[0, i] == pytest.approx(scores[1, i])
    monkeypatch.setattr(lattice, "LONG", 1)
    assert lattice.word_scores(sample, pieces) == pytest.approx(scores)
    assert np.isfinite(lattice.word_scores(["y" * 4000], pieces)).all()


def test_long_words_enter_the_counts(pieces, monkeypatch):
    words = ["nation", "unhappiness", "x", "日本語", "a" * 30]
    seen = np.array([[1.0, 1, 1, 0, 2], [0, 1, 0, 1, 1]])
    counts, other = lattice.expected_counts(words, seen, pieces)
    monkeypatch.setattr(lattice, "LONG", 1)
    again, more = lattice.expected_counts(words, seen, pieces)
    assert np.allclose(again, counts, atol=1e-9) and np.allclose(more, other, atol=1e-9)
    # far beyond what a double can hold, and over the border of the parts the way back is done in
    long, one = "nation" * 1500, np.ones((2, 1))
    counts, other = lattice.expected_counts([long], one, pieces)
    assert np.isfinite(counts).all() and (other == 0).all() and counts.sum(axis=1).min() > 1000
    whole = [np.array(list(lattice._backwards(np.arange(10, dtype=np.uint64), pieces, part)), dtype=object)[:, 0].tolist() for part in (3, 4096)]
    assert whole[0] == whole[1] == list(range(9, -1, -1))


def test_expected_counts_add_up(pieces):
    sample = ["the", "thering", "日本", "and,"]
    counts, other = lattice.expected_counts(sample, np.array([[1, 1, 1, 1], [1, 0, 0, 0]]), pieces)
    assert counts.shape == pieces.weights.shape and counts[1].sum() < counts[0].sum()
    again = pieces
    before = lattice.word_scores(sample, again)[0].sum()
    for _ in range(5):
        c, o = lattice.expected_counts(sample, np.ones((2, 4)), again)
        again = lattice.refitted(again, c, o, np.full(2, 4.0))
    assert lattice.word_scores(sample, again)[0].sum() > before


@pytest.mark.parametrize("near_words", [0, 20, 1 << 19])
def test_scores(spark, near_words):
    texts = awkward()
    rows = lattice.lm_scores(frame(spark, [*texts.items(), (41, ""), (None, "the")]), rounds=1, near_words=near_words).collect()
    assert len(rows) == len(texts) + 2
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    everything = {**texts, None: "the"}
    listed = {i: [*words((t or "").translate(low)), None] for i, t in everything.items()}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in everything}
    counts = Counter(w for i in [*texts, 41, None] if not held[i] for w in listed[i])
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        tokens = listed[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens))
        assert math.isfinite(r.score) and r.score < 0
    if near_words == 20:
        other = {r.doc_id: r.score for r in lattice.lm_scores(frame(spark, [*texts.items(), (41, ""), (None, "the")], 2), rounds=1).collect()}
        assert all(r.score == pytest.approx(other[r.doc_id], rel=1e-5) for r in rows)


def test_no_training_texts(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lattice.lm_scores(spark.createDataFrame([(held, "the cat")], "doc_id long, text string")).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isfinite(row.score)
    assert lattice.lm_scores(frame(spark, {1: "x"}).limit(0)).count() == 0
