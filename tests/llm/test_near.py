from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bartide.llm import near
from bartide.llm.common import batch_words
from bartide.llm.components import components


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def exact(a, b):
    """Probability Jaccard similarity straight from its definition."""
    union = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in union) for i in set(a) & set(b))


def brute_classes(texts):
    """Smallest id of the class of each text, by comparing all pairs."""
    bags = {i: bag(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a] == texts[b] or (bags[a].keys() & bags[b].keys() and exact(bags[a], bags[b]) >= 0.8):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 200))) for _ in range(60)]
    hot = rng.choices(vocabulary, k=120)
    texts += [edited(rng, hot, rng.randrange(0, 6)) for _ in range(90)]  # one large group, at and around the threshold
    line = " ".join(rng.choices(vocabulary, k=12))
    looped = "\n".join([line] * 6)
    texts += [looped, looped + "\n" + line, looped + " " + edited(rng, line.split(), 1)]  # weighted shingles
    texts += [texts[3], texts[3], "", "", "   ", "one two", "one two", "one two three", None]
    return dict(enumerate(texts, 100))


def test_classes_equal_all_pairs(spark, corpus):
    frame = spark.createDataFrame(list(corpus.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 as copies", "'x' as key", "0 as bucket").repartition(5)
    found = {r.doc_id: r for r in near.near_classes(frame, block_bytes=4000).collect()}  # small blocks: hot buckets are split
    expected = brute_classes({i: t or "" for i, t in corpus.items()})
    assert {i: r.class_id for i, r in found.items()} == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in found.values())


def test_block_of_repeated_lines_equals_all_pairs():
    rng = random.Random(9)
    draw = lambda n: " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))
    line, base = draw(12), draw(90)
    texts = ["\n".join([line] * 100) + "\n" + draw(n) for n in [40] * 8 + [5, 90, 200, 240, 280, 600, 900]]
    texts += [base, base + " " + draw(3), base + " " + draw(60), line, line + " " + draw(1)]
    bags, columns = [bag(t) for t in texts], list(near.bag_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])))[0]
    blocks = [pa.Table.from_batches([columns]).append_column("component", pa.array(range(len(texts)))).append_column("first", pa.array([first] * len(texts))) for first in (True, False)]
    found = near.block_links(pa.concat_tables(blocks), 0.8).to_pydict()
    expected = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and exact(bags[a], bags[b]) >= 0.8}
    assert set(zip(found["a"], found["b"])) == expected and len(expected) > 56


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "x")]
    found = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == [(1, 1), (1, 1), (2, 2), (None, None)]
    empty = near.near_classes(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "class_id", "kept"] and empty.count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
        cut = int(rng.integers(0, 60))
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64))))
        v, w = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
        sign = near.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), np.concatenate((v, w)), 2, 600)
        short = [(x >> np.uint64(32)).astype(np.uint32) for x in (a, b)]
        truth = near.similarity(short[0], v, short[1], w)
        assert truth == pytest.approx(exact(Counter(dict(zip(a.tolist(), v))), Counter(dict(zip(b.tolist(), w)))))
        errors.append((sign[0] == sign[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_words_of_long_texts_are_cut_safely(monkeypatch):
    texts = ["", "a  b\tc", "x" * 50, "é" * 9 + " ö " * 40, " "]
    whole = batch_words(pa.array(texts), spans=True)
    monkeypatch.setattr("bartide.llm.common.PIECE_BYTES", 16)
    parts = batch_words(pa.array(texts), spans=True)
    assert all((x == y).all() for x, y in zip(whole, parts))
    data = "".join(texts).encode()
    assert [data[b:e].decode() for b, e in zip(whole[2], whole[3])] == [w for t in texts for w in t.split()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 150)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {150: 150, 200: 150}
