from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark import cloudpickle

from bartide.llm import leaks


def words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def brute_tiles(text, item, least):
    """Greedy string tiling by its definition: look for the longest unmarked match, mark it, repeat."""
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        total += n


def test_tiles_by_width_equal_the_definition():
    rng = random.Random(9)
    for _ in range(150):
        kinds = rng.choice([2, 3, 12])
        text, item = ([rng.randrange(kinds) for _ in range(rng.randrange(1, 60))] for _ in range(2))
        if rng.random() < 0.5:
            item[3:3] = text[10:30]
        a, b = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (text, item))
        found = leaks.tiles_by_width(a, b, 3)
        assert sum(n for *_, n in found) == brute_tiles(text, item, 3) and all(text[i:i + n] == item[j:j + n] for i, j, n in found)


def test_loops_of_a_few_words_are_not_listed():
    import pyarrow as pa
    loop = "one two three four five six seven " * 20_000
    block = leaks.block_of([(1, "one two three four five six seven " * 120), (2, "seven one two three four five eight " * 3), (3, "nothing of it at all here")])
    begun = time.perf_counter()
    found = {m[1]: m[3:5] for m in leaks.matches(pa.array([loop, "seven one two three four five eight"]), block) if m[0] == 0}
    assert found[0] == (840, 840) and found[1] == (18, 21) and 2 not in found and time.perf_counter() - begun < 20


@pytest.mark.parametrize("listed", [0, leaks.LISTED])
def test_equals_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(leaks, "LISTED", listed)
    cloudpickle.register_pickle_by_value(leaks)  # so that workers take the number along
    try:
        check_brute_force(spark)
    finally:
        cloudpickle.unregister_pickle_by_value(leaks)


def check_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "in"] + [f"w{i}" for i in range(30)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(6, 30))) for i in range(12)}
    items |= {50: "Too few words", 51: None, 52: "", 53: "the the the the the the the the"}
    texts = {}
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randrange(5, 80))
        if i % 2:
            passage = items[i % 12].split()
            cut = rng.randrange(1, len(passage))
            passage = passage[cut:] + ["x"] * (i % 3) + passage[:cut]  # halves change places
            body[10:10] = [w.upper() + "," for w in passage]
        texts[i] = " ".join(body)
    texts |= {100: "too few WORDS!", 101: "there are too few words", 102: None, 103: "", 104: "the " * 500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1L as item_id", "0 as coverage").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for share, block in ((0.5, 1 << 20), (0.2, 200)):
        found = {(r.doc_id, r.item_id): r.covered_words for r in leaks.contaminated(docs, bench, share, block_bytes=block).collect()}
        expected = {}
        for d, t in texts.items():
            for i, item in items.items():
                a, b = words(t), words(item)
                if b and (n := brute_tiles(a, b, 5) if len(b) >= 5 else len(b) * (a == b)) >= share * len(b):
                    expected[d, i] = n
        assert found == expected and len(expected) > 20
    kept = leaks.without_leaks(docs, bench).collect()
    bad = {r.doc_id for r in leaks.contaminated(docs, bench).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(set(texts) - bad) and kept[0].asDict().keys() == set(docs.columns)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert leaks.contaminated(docs, bench.limit(0)).count() == 0
    assert leaks.contaminated(docs.limit(0), bench).count() == 0
    assert leaks.contaminated(docs.union(docs), bench).count() == 2
    assert leaks.without_leaks(docs, bench.limit(0)).count() == 1
    assert [r.coverage for r in leaks.contaminated(docs, bench).collect()] == [pytest.approx(1.0)]
