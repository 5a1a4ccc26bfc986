"""Repeated passages, chat formatting, shards and the pipeline against plain Python and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from bartide.llm import bytebpe, chat, sharding, units
from tests.llm.corpus import awkward, base_counts, frame, repeated_runs, words
from tests.llm.test_leaks import brute_tiles
from tests.llm.test_leaks import words as letters
from tests.llm.test_near import brute_classes


def test_all_operators_are_registered():
    names = list(contract.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)


# ---- repeated passages

def test_repeated_passages(spark):
    texts = awkward()
    for least, marks in ((5, units.CLAUSES), (units.MIN_WORDS, units.CLAUSES), (5, units.SENTENCES), (units.SENTENCE_WORDS, units.SENTENCES)):
        found = {(r.doc_id, r.start, r.end): r.n_words for r in units.repeated_passages(frame(spark, [*texts.items(), (47, texts[47]), (None, texts[47])]), least, marks).collect()}
        assert found == repeated_runs(texts, least, marks) and any(k[0] == 48 for k in found)


def test_cut_texts(spark):
    texts = awkward()
    docs = frame(spark, texts)
    spans = units.repeated_passages(docs, 5)
    left = {r.doc_id: r.text for r in units.without_spans(docs, spans).collect()}
    runs = defaultdict(list)
    for doc, start, end in repeated_runs(texts, 5):
        runs[doc].append((start, end))
    for doc, text in texts.items():
        for start, end in sorted(runs[doc], reverse=True):
            text = text[:start] + text[end:]
        assert left[doc] == text
    assert units.without_spans(docs, spans).columns == docs.columns
    assert units.repeated_passages(docs.limit(0)).count() == 0


def brute_windows(texts, least):
    """{(doc_id, start, end)} by a table of all windows of `least` words, in order of doc_id."""
    seen, out = set(), set()
    for doc in sorted(texts):
        spots = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[doc] or "")]
        windows = [tuple(w for _, _, w in spots[i:i + least]) for i in range(len(spots) - least + 1)]
        held = sorted({i + k for i, w in enumerate(windows) if w in seen for k in range(least)})
        for first in (i for i in held if i - 1 not in held):
            last = first
            while last + 1 in held:
                last += 1
            out.add((doc, spots[first][0], spots[last][1]))
        seen |= set(windows)
    return out


def test_passages_that_begin_and_end_inside_sentences(spark, tmp_path):
    rng = random.Random(31)
    draw = lambda n: " ".join(rng.choice(["é", "W", "x"]) + str(rng.randrange(400)) for _ in range(n))
    passage = f"{draw(20)}. {draw(22)}! {draw(18)}"
    texts = {i: f"{draw(rng.randrange(20, 90))}. {draw(30)}" for i in range(30)}
    texts |= {40: f"{draw(9)} {passage} {draw(9)}.", 41: f"{draw(30)} {passage.upper()}\t{draw(30)}.", 42: draw(130), 44: None, 45: "", 46: "loop " * 200, 47: "loop " * 120 + "end"}
    texts |= {43: " ".join(texts[42].split()[20:90]) + " " + draw(8) + " " + passage + " " + " ".join(texts[42].split()[60:115]), 48: passage.replace(" ", "  ", 5)[:-4]}
    docs = frame(spark, [*texts.items(), (43, texts[43]), (None, texts[42])])
    expected = brute_windows({i: t for i, t in texts.items()}, units.WINDOW_WORDS)
    assert {d for d, _, _ in expected} == {41, 43, 47, 48}
    rows = units.repeated_windows(docs).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == expected and len(rows) == len(expected)
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, frame(spark, texts), str(tmp_path)).collect()}
    assert passage in left[40] and len(left[41].split()) == 60 and left[42] == texts[42]


# ---- chat

def brute_examples(turns, pairs):
    out = {}
    plain = lambda t: (t or "").replace("<|", "< |")
    role = lambda t: "unknown" if t[0] is None else t[0].strip(" ").lower()
    head = lambda t: f"<|{plain(role(t))}|>\n"
    body = lambda t: f"{plain(t[1])}<|end|>\n"
    for key, (a, b) in pairs.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        n = max(min(n, len(a) - 1, len(b) - 1), 0)
        show = lambda x: "".join(head(t) + body(t) for t in x)
        mask = lambda x: "".join("0" * len(head(t)) + ("1" if role(t) == "assistant" else "0") * len(body(t)) for t in x)
        out[key] = (n, show(a[:n]), show(a[n:]), mask(a[n:]), show(b[n:]), mask(b[n:]))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for c in range(0, 9000, 37):
        opening = "the same opening" if c % 3 == 0 else f"opening {c}"
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, [" User", "assistant", "Assistant "][t % 2 if c % 2 else (2 if t % 2 else 0)], opening if t == 0 else rng.choice(["yes", "no", "né <|end|> x", "long " * 30])))
    rows += [r for r in rows if r[0] in (37, 74)]  # repeated rows
    rows += [(20_000 + r[0], *r[1:]) for r in rows if r[0] in (111, 222)]  # copies of conversations
    rows += [(30_000, None, None, None), (30_000, 1, "assistant", None), (30_001, 0, "user", ""), (None, 0, "user", "x"), (30_002, 1, "assistant", "a"), (30_002, 1, "assistant", "b")]
    return rows


def test_examples_equal_python_and_sql(spark, talks):
    turns = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    frame_ = turns.selectExpr("*", "1 as turns", "'x' as opening", "2 as whole", "3 as a").repartition(4)
    rows = chat.chat_preferences(frame_).collect()
    columns = ["kind", "conv_id", "other_id", "n_shared", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    db = duckdb.connect()
    conversations = turns.toPandas()
    db.register("conversations", conversations)
    assert sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({chat.SQL})").fetchall()) == sorted(tuple(r[c] for c in columns) for r in rows)

    whole = defaultdict(set)
    for c, t, role, text in talks:
        if c is not None:
            whole[c].add((t, role, text))
    order = lambda t: [(x is not None, x if x is not None else 0) for x in (t[0],)] + [(x is not None, x or "") for x in t[1:]]
    whole = {c: tuple((t[1], t[2]) for t in sorted(ts, key=order)) for c, ts in whole.items()}
    first = {}
    for c in sorted(whole):
        first.setdefault(whole[c], c)
    groups = defaultdict(list)
    for c in sorted(first.values()):
        groups[whole[c][0]].append(c)
    pairs = {}
    for ids in groups.values():
        for a, b in zip(ids, ids[1:]):
            a, b = (a, b) if len(whole[a]) >= len(whole[b]) else (b, a)
            pairs["sibling", a, b] = (whole[a], whole[b])
    for c, t in whole.items():
        at = [i for i, x in enumerate(t) if x[0] and x[0].strip().lower() == "assistant"]
        if len(at) > 1 and t[at[0]][1] != t[at[-1]][1]:
            pairs["stale", c, c] = (t, t[:at[-1]] + (t[at[0]],) + t[at[-1] + 1:])
    assert {(r.kind, r.conv_id, r.other_id): tuple(r)[3:] for r in rows} == brute_examples(whole, pairs)
    assert all(len(r.chosen) == len(r.chosen_mask) and len(r.rejected) == len(r.rejected_mask) and r.chosen and r.rejected for r in rows) and len(rows) > 100


def test_null_pairs_and_empty_table(spark):
    kind = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = [(1, None, [("user", "a")]), (2, [], []), (3, [("user", "a")], [("user", "a")]), (4, [("user", "a"), ("assistant", "b")], [("user", "a")])]
    found = {r.pair_id: r for r in chat.preference_examples(spark.createDataFrame(rows, kind)).collect()}
    assert found[1].chosen == "" and found[1].n_shared == 0 and found[2].rejected == "" and found[3].n_shared == 0 and found[4].n_shared == 0
    assert chat.chat_preferences(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- shards

def brute_capacity(sizes, shards):
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, n = 0, 1
        for s in sizes:
            used, n = (used + s, n) if used + s <= capacity else (s, n + 1)
        if n <= shards:
            return capacity


def test_least_capacity():
    rng = random.Random(1)
    for _ in range(300):
        sizes = sorted((rng.choice([1, 2, 3, 5, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 40))), reverse=True)
        runs, shards = sorted(Counter(sizes).items(), reverse=True), rng.randrange(1, 9)
        assert sharding.least_capacity(runs, shards) == brute_capacity(sizes, shards)
        starts = [sum(g for s, g in runs if s > size) + before for size, before in sharding.cuts(runs, shards)]
        assert starts == sorted(set(starts)) and len(starts) < shards
        parts = [sum(sizes[a:b]) for a, b in zip([0, *starts], [*starts, len(sizes)])]
        assert max(parts) == brute_capacity(sizes, shards)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 7)
    texts = awkward() | {i: f"text {i % 150}" for i in range(100, 500)}
    texts.pop(50)  # one text of nearly all bytes is its own case below
    rows = sharding.sharded(frame(spark, [*texts.items(), (7, texts[7])])).collect()
    assert len(rows) == len(texts) + 1
    shards, by_text, sums = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < 8
        shards[r["shard"]].append(r.slot)
        by_text[texts[r.doc_id]].add(r["shard"])
        sums[r["shard"]] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in by_text.values())
    groups = Counter()
    for r in rows:
        groups[texts[r.doc_id]] += r.size
    assert max(sums.values()) == brute_capacity(sorted(groups.values(), reverse=True), 8)
    assert sharding.sharded(frame(spark, texts).limit(0)).count() == 0
    big = sharding.sharded(frame(spark, {1: "x" * 900, 2: "a", 3: "bb", 4: "ccc", 5: "dddd"})).collect()
    assert {r.doc_id: r["shard"] for r in big}[1] == 0 and len({r["shard"] for r in big}) == 5


# ---- pipeline

def test_pipeline_equals_plain_python(spark, tmp_path):
    texts = {i: t for i, t in awkward().items()}
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(300)]
    for i in range(200, 240):
        texts[i] = ". ".join(" ".join(rng.choices(vocabulary, k=11)) for _ in range(8)) + "."
    passage = texts[200][:400]
    items = {1: " ".join(rng.choices(vocabulary, k=30)), 2: "no such words here at all"}
    texts[240] = texts[201] + " extra"
    texts[241] = texts[202] + " " + passage
    texts[242] = texts[203].replace(". ", " ", 3) + " " + items[1].title()
    texts[243] = texts[204]
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t in texts.items() if (c := base_counts(t))[0] >= 50 and 2 * c[4] <= c[0]}
    classes = brute_classes(kept)
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    assert 240 not in kept and 243 not in kept and 241 in kept
    runs = defaultdict(list)
    for doc, start, end in repeated_runs(kept, units.SENTENCE_WORDS, units.SENTENCES):
        runs[doc].append((start, end))
    assert 241 in runs
    for rule in (runs, None):
        if rule is None:  # windows of what is left
            rule = defaultdict(list)
            for doc, start, end in brute_windows(kept, units.WINDOW_WORDS):
                rule[doc].append((start, end))
        for doc, spans in rule.items():
            for start, end in sorted(spans, reverse=True):
                kept[doc] = kept[doc][:start] + kept[doc][end:]
    kept = {i: t for i, t in kept.items() if words(t)}
    kept = {i: t for i, t in kept.items() if not any(brute_tiles(letters(t), letters(x), 5) >= 0.5 * len(letters(x)) for x in items.values())}
    assert 242 not in kept
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.rank_table(public_tokenizers.path(bytebpe.RANKS)), special_tokens={})
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in found} == {i: library.encode_ordinary(t) for i, t in kept.items()} and len(found) == len(kept)


def test_stages_pass_empty_tables_and_rows_without_id(spark, tmp_path):
    docs = frame(spark, [(None, "no id " * 60 + "a b c"), (3, "x")]).select("doc_id", "text", "lang", "source", "n_chars", "key", "n")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 2


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    texts = {i: t for i, t in awkward().items() if i < 60 and i != 50}
    docs = frame(spark, texts).drop("n_chars").selectExpr("*", "1 as `a.b`", "'s' as _spans", "'t' as spans", "2 as length", "3 as barrier", "4 as text_hash", "5 as `row.x`", "6 as bucket", "7 as `b``c`")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() > 0 and {r["a.b"] for r in out.collect()} == {1}, name


def test_kept_windows_are_compared_word_by_word(spark):
    from bartide.llm import quality
    texts = awkward()
    for r in quality.measured(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id])


def test_copies_of_a_labelled_text_are_one_trial(spark):
    from bartide.llm import quality
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    good = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = {i: good[i % 4] for i in range(3000)} | {5000 + i: " ".join(word() for _ in range(50)) + " " + "#" * 400 for i in range(40)}
    docs = frame(spark, texts).withColumn("lang", quality.F.lit("en"))
    labels = spark.createDataFrame([(d, int(d < 5000)) for d in texts], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    assert all(r.failed_rules == "" for r in rows)  # four good texts prove no cutoff, three thousand copies of them neither
