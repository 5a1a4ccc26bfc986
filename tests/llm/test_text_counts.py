"""Token counts, byte-level BPE and quality rules against the public libraries and plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from bartide.llm import bytebpe, quality, tokens
from tests.llm.corpus import awkward, base_counts, frame


def test_token_counts(spark):
    texts = awkward()
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    found = {r.doc_id: r for r in tokens.token_counts(frame(spark, texts)).collect()}
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((t or "").encode()), n > 512), i
    assert len(found) == len(texts)


def test_single_tokens_are_those_of_the_library():
    path = public_tokenizers.path(tokens.VOCABULARY)
    library, single = Tokenizer.from_file(path), tokens.proven_single(path)
    assert len(single) > 45_000
    for word in random.Random(2).sample(sorted(single), 3000):
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.rank_table(public_tokenizers.path(bytebpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_round_trip(spark, library):
    texts = awkward()
    frame_ = bytebpe.encoded(frame(spark, texts))
    found = {r.doc_id: r for r in frame_.collect()}
    back = {r.doc_id: bytes(r.data) for r in bytebpe.decoded(frame_).collect()}
    for i, t in texts.items():
        ids, data = library.encode_ordinary(t or ""), (t or "").encode()
        assert found[i].ids == ids and found[i].n_tokens == len(ids) and back[i] == data
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(data).hexdigest()


def test_segment_tree_merges_like_the_library(library):
    rng = random.Random(4)
    ranks = bytebpe.rank_table(public_tokenizers.path(bytebpe.RANKS))
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 16, 33, 400]:
        for _ in range(40):
            piece = "".join(rng.choices("aeiouthnsr éüñ"[:11 + n % 3], k=n)).replace(" ", "e")
            assert bytebpe.encode_piece(piece.encode(), ranks) == library._core_bpe.encode_single_piece(piece.encode()), piece


def test_base_counts(spark):
    texts = awkward()
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judged(frame(spark, texts), labels).collect()}
    assert len(found) == len(texts)
    for i, t in texts.items():
        r, counts = found[i], base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, i
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed) and r.failed_rules == ""  # too few labels for any rule


def test_binomial_bound(spark):
    cases = [(n, rate, level) for n in (0, 1, 50, 400, 3000) for rate in (0.01, 0.05) for level in (1e-4, 0.05)]
    for n, rate, level in cases:
        best, tail = -1, 0.0
        for k in range(int(n * rate) + 1):
            tail += math.comb(n, k) * rate**k * (1 - rate)**(n - k)
            best = k if tail <= level else best
        got = spark.range(1).select(quality.allowed_rejections(f"cast({n} as bigint)", rate, repr(level) + "D").alias("k")).first()["k"]
        assert got == best, (n, rate, level)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(5200):
        lang, good = ("en" if i % 4 else "de"), i % 5 > 0
        body = [f"w{rng.randrange(900)}" for _ in range(60)]
        if not good and i % 2:
            body = [w.upper() + "!!" for w in body]
        elif not good:
            body = [w + "%%%" for w in body]
        if good and i % 800 == 1:
            body = [w.upper() + "!!" for w in body]  # a few good documents look bad
        docs.append((i, " ".join(body), lang))
        labels.append((i, int(good), 0))
    docs += [(6000, None, "en"), (6001, "short", None), (6002, " ".join(["x%% y"] * 40), None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_keep_the_risk_and_equal_sql(spark, labelled):
    docs, labels = labelled
    rows = quality.judged(docs.withColumn("good", docs.doc_id), labels).collect()
    assert any("capitals" in r.failed_rules for r in rows) and any("symbols" in r.failed_rules for r in rows)
    for remainder in (range(1, 4), range(0, 1)):
        good = [r for r in rows if r.doc_id < 5200 and r.doc_id % 5 and r.doc_id % 4 in remainder]
        assert sum(not r.kept for r in good) <= quality.RISK * len(good)
    db = duckdb.connect()
    documents, labels = docs.toPandas(), labels.toPandas()
    db.register("documents", documents)
    db.register("labels", labels)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules"
    assert sorted(db.execute(f"SELECT {columns} FROM ({quality.SQL})").fetchall()) == sorted(tuple(r[c] for c in columns.split(", ")) for r in rows)


def test_kept_documents_are_the_judged_ones(spark, labelled):
    docs, labels = labelled
    docs = docs.selectExpr("*", "1 as n_words", "'r' as row", "length(text) as n_chars")
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.judged(docs, labels).collect() if r.kept)


def test_empty_tables(spark):
    empty = frame(spark, {1: "x"}).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert tokens.token_counts(empty).count() == bytebpe.encoded(empty).count() == quality.judged(empty, labels).count() == quality.kept_documents(empty, labels).count() == 0
    assert tokens.token_counts(frame(spark, [(1, "a b"), (1, "a b"), (None, None)])).count() == 3
