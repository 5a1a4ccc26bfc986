"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from bartide.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_paths(rows):
    """conv_id -> turns (role, text), rebuilt."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tied = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found[conv].append((turn is not None, turn or 0, role, tied, text))
    found = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in found.items()}
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = found.get(int(c / 100) * 100, [])[:h] + own[h:]  # % truncates
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, m in members.items():
        own = (len(m) - 1) * len(key[-1][1]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += children[key] == 0
            saved[key[:d]] += own
    rows = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(key))
        rows.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), children[key], leaves[key], saved[key], sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def awkward_turns():
    rng = random.Random(5)
    words = ["", "a", "été", "\U0001F600 b", "line\nend", None]
    rows = []
    for c in [*range(0, 320), -7, 1000, 1000000007, 5000, 5001]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(words)))
    rows += [(400 + k, t, "user", "same") for k in range(60) for t in range(9)]      # copies of one conversation
    rows += [(700, t, "user", f"turn {t}") for t in range(700)] + [(701, t, "user", f"turn {t}") for t in range(650)]
    rows += [(None, 0, "user", "no id"), (0, 0, "user", "tie"), (0, 0, "user", "tie"), (205, 1, "user", "x")]
    return rows


def frame(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.selectExpr("*", "1 as node", "2 as depth", "3 as path", "4 as member", "5 as part", "6 as `a.b`", "7 as base", "8 as h").repartition(7)


@pytest.mark.parametrize("size", [1, 40, trie.SHARD_NODES])
def test_trie(spark, size):
    rows = awkward_turns()
    nodes = trie.prefix_trie(trie.rebuilt(trie.conversations_of(frame(spark, rows))), size)
    assert sorted((tuple(r) for r in nodes.select(COLUMNS).collect()), key=repr) == plain_trie(plain_paths(rows))


def test_no_conversations_and_one_without_turns(spark):
    assert trie.conversation_trie(frame(spark, awkward_turns()).limit(0)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base is absent, its only turn is replaced
    rows = trie.conversation_trie(frame(spark, [(lone, 3, "user", "x")])).select(COLUMNS).collect()
    assert [tuple(r) for r in rows] == [(lone, 0, None, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]


def test_many_ids_end_at_one_node(spark):
    ids = [*range(0, 30000, 7), 10 ** 12]
    paths = spark.createDataFrame([("n", i) for i in ids] + [("m", 5)], "node string, conv_id long").repartition(6)
    found = {r.node: r.ends_sha256 for r in trie.end_digests(paths).collect()}
    assert found == {"n": sha256(",".join(map(str, ids)).encode()).hexdigest(), "m": sha256(b"5").hexdigest()}


def test_find_close_equals_a_stack():
    rng = random.Random(3)
    for n in (1, 2, 30, 31, 32, 33, 500, 9000):
        bits, open_, closed = [], [], {}
        while len(bits) < 2 * n:
            opened = sum(bits)
            if opened < n and (not open_ or rng.random() < 0.55):
                open_.append(len(bits))
                bits.append(True)
            else:
                closed[open_.pop()] = len(bits)
                bits.append(False)
        tree = trie.Parentheses(np.array(bits))
        opens = np.flatnonzero(bits)
        closes = tree.find_close(opens)
        assert closes.tolist() == [closed[i] for i in opens.tolist()]
        leaf = [i for i in range(2 * n - 1) if bits[i] and not bits[i + 1]]
        assert tree.leaf_pairs(opens, closes).tolist() == [sum(a <= i <= b for i in leaf) for a, b in zip(opens.tolist(), closes.tolist())]
