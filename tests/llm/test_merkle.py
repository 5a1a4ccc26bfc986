"""The Merkle manifest against one plain tree per source."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from bartide.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, per node its siblings as (left, right) by level)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for k, at in enumerate(own):
            run, spot = runs[at // 3], at % 3
            paths[k].append(("".join(run[:spot]), "".join(run[spot + 1:])))
            own[k] = at // 3
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for row in rows:
        doc, source, lang, n, text = row
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None
        groups[source].append((doc is not None, doc or 0, leaf(*row), leaf(doc, source, lang, n, text.replace("\n", "")) if hit else leaf(*row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([g[2] for g in sorted(groups[s])]) for s in order}
    root, over = tree([tops[s][0] for s in order])
    out = []
    for s, outer in zip(order, over):
        for (known, doc, own, found), path in zip(sorted(groups[s]), tops[s][1]):
            for left, right in path + outer:
                found = digest(left + found + right)
            out.append((doc if known else None, own, tops[s][0], root, digest("".join(a + b for a, b in path + outer)), found, found == root))
    return sorted(out, key=repr)


def awkward_documents():
    rows = [(i, "hot", ("en", "fr", None)[i % 3], i, f"line {i}\nnext" if i % 4 else f"line {i}") for i in range(2000, 400, -1)]
    rows += [(i, f"s{i % 40}", "en", None, "é\n\n") for i in range(300)] + [(5, "é", None, 1, None), (6, None, "x", 2, ""), (7, None, "x", 2, "\n"), (8, "", "x", 2, "a" * 70000)]
    return rows + [(None, "hot", "en", 3, "a\nb"), (None, "hot", "en", 3, "a\nb"), (1 << 60, "hot", "en", 3, "a\nb"), (500, "hot", "en", 3, "again"), (500, "hot", "en", 3, "again")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return docs.selectExpr("*", "1 as tree", "2 as place", "3 as leaf", "4 as block", "5 as `x.y`", "6 as part", "7 as local").repartition(6)


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    rows = awkward_documents() if levels > 1 else awkward_documents()[:30] + awkward_documents()[1600:]
    # workers import the module anew, so the functions they run take the patched numbers along
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(merkle)
    try:
        found = merkle.dataset_manifest(frame(spark, rows)).select(COLUMNS).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(merkle)
    assert sorted((tuple(r) for r in found), key=repr) == plain_manifest(rows)
    assert {r.verified for r in found} == {True, False}


def test_empty_and_single(spark):
    docs = frame(spark, awkward_documents())
    assert merkle.dataset_manifest(docs.limit(0)).count() == 0
    row = merkle.dataset_manifest(frame(spark, [(3, None, None, None, None)])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == digest("1:3----") and row.verified and row.proof_sha256 == digest("")


@pytest.mark.parametrize("n", [0, 1, 10, 5000])
def test_numbers_without_gaps(spark, n):
    rows = merkle.stored(spark.range(n).selectExpr("if(id % 3 = 0, 'a', concat('b', id % 50)) as g", "id % 7 as o"))
    found = defaultdict(list)
    for r in merkle.numbered(rows, "g", ["o"]).collect():
        found[r.g].append((r.o, r.place))
    for g, places in found.items():
        assert sorted(p for _, p in places) == list(range(len(places))) and [o for o, _ in sorted(places, key=lambda x: x[1])] == sorted(o for o, _ in places)
