"""Language identification against plain Python and on held-out documents."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
import regex
import zstandard

from bartide.llm import langid
from tests.llm.corpus import awkward
from tests.llm.corpus import frame as documents_frame

SETTINGS = dict(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=18, chain_log=17, hash_log=16, search_log=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)


def letters(text):
    return " ".join(regex.findall(r"[\p{L}\p{M}]+", text.lower())).encode()


def plain_model(rows, size=langid.DICTIONARY_BYTES):
    """rows: (lang, text) -> [(lang, dictionary)] in the order of ties"""
    texts = {}
    for lang, text in rows:
        if lang is not None and text:
            texts.setdefault(lang, set()).add(text)
    model = {}
    for lang, found in texts.items():
        counts = Counter(w for t in found for w in set(letters(t).decode().split()) if len(w.encode()) <= 40)
        kept, used = [], 0
        for word in sorted(counts, key=lambda w: (-counts[w], w.encode())):
            used += len(word.encode()) + 1
            if used > size:
                break
            kept.append(word)
        if kept:
            model[lang] = " ".join(reversed(kept)).encode()
    return sorted(model.items(), key=lambda m: (-len(texts[m[0]]), m[0]))


def plain_sizes(model, text):
    out = []
    for _, content in model:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**SETTINGS))
        encoder = zstandard.ZstdCompressor(dict_data=own, compression_params=zstandard.ZstdCompressionParameters(**SETTINGS))
        plain = letters(text)
        out.append(sum(len(encoder.compress(plain[i:i + 4096])) for i in range(0, len(plain), 4096)))
    return out


def labelled():
    rng = random.Random(2)
    parts = {"en": "the ing ough tion and wh ea".split(), "fr": "eau eux ait qu é ou ment".split(), "de": "sch ung ein ß keit ü ver".split()}
    word = lambda lang: "".join(rng.choices(parts[lang], k=rng.randrange(1, 4)))
    return [(lang, " ".join(word(lang) for _ in range(rng.randrange(1, 60)))) for lang in parts for _ in range({"en": 40, "fr": 30, "de": 30}[lang])]


def test_dictionaries_and_sizes(spark):
    rows = labelled()
    data = spark.createDataFrame([*rows, *rows[:9], (None, "no language"), ("en", None), ("xx", ""), ("yy", "12 34")], "lang string, text string").repartition(5)
    for size in (200, langid.DICTIONARY_BYTES):
        model = langid.fit(data, size=size)
        assert model == plain_model([*rows, ("yy", "12 34")], size) and [m[0] for m in model] == ["en", "de", "fr"]
    texts = awkward() | {900 + i: t for i, (_, t) in enumerate(rows)} | {60: "12 ½ ² !?", 61: "ñ", 62: "ABC dEf"}
    found = langid.languages(documents_frame(spark, [*texts.items(), (None, "the and"), (43, "again")]), model).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        if r.doc_id is None or (r.doc_id == 43 and r.score > 0):
            continue
        text = texts[r.doc_id]
        if text is None or not regex.search(r"\p{L}", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = plain_sizes(model, text)
        best = sizes.index(min(sizes))
        assert r.lang_pred == model[best][0] and 0 < r.score <= 1
        margin = (sorted(sizes)[1] - sizes[best]) / sizes[best]
        assert r.margin == pytest.approx(margin) and r.rejected == (margin < langid.LEAST_MARGIN)


def test_nothing_to_learn(spark):
    docs = documents_frame(spark, awkward()).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in langid.language_ids(docs).collect()} == {("und", 0.0)}
    assert langid.language_ids(docs.limit(0)).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(spark.createDataFrame(labelled(), "lang string, text string"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_ids(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97
