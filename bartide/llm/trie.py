"""Prefix trie of conversations, built in shards that are encoded as balanced parentheses.

A conversation is a path: the digests of its turns (role and text), joined. Equal paths are one row with their number, so that copies
never meet. The different paths are sorted by range, which spreads also a first turn that all share; a task walks
through its sorted paths and cuts them into shards of about SHARD_NODES nodes. A shard is a sequence of parentheses in preorder with
blocks of their least excess: findclose delimits the subtree of a node, the rank of `()` counts its leaves, differences of cumulative
arrays give its conversations and savings, and a table of minima its smallest member.

Only the nodes on a shard's spines, the paths to its first and last leaf, may go on in another shard. They are written with what their
subtree holds inside the shard and merged by the digest of their path; what a merged node itself adds to its ancestors is summed
along the spine of one of its shards.

The turns of one conversation are a list of digests and lengths inside a task (36 bytes a turn); their texts are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import crc32_sql, join_heavy, stored

#: nodes from which on a shard is closed
SHARD_NODES = 1 << 16
#: hexadecimal digits of a turn's digest
DIGITS = 32
#: parentheses whose least excess is one entry of the lowest level
PAREN_BLOCK = 64
#: ids that are joined before they are sent to the task that hashes the ids of a node
IDS_PER_PIECE = 1024
NO_IDS = sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with range-min blocks over its excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        pad = -len(bits) % PAREN_BLOCK
        self.levels = [np.concatenate((self.excess, np.full(pad, len(bits) + 1))).reshape(-1, PAREN_BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            level = self.levels[-1]
            self.levels.append(np.concatenate((level, np.full(len(level) % 2, len(bits) + 1))).reshape(-1, 2).min(axis=1))
        pairs = np.zeros(len(bits) + 1, np.int64)
        pairs[1:] = np.cumsum(np.append(bits[:-1] & ~bits[1:], False)) if len(bits) else 0
        self._pairs = pairs

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each of `opens`: the first place behind it with a smaller excess than its own."""
        goal = self.excess[opens] - 1
        out = np.full(len(opens), -1, np.int64)
        block = opens // PAREN_BLOCK
        self._scan(opens + 1, (block + 1) * PAREN_BLOCK, goal, out, np.arange(len(opens)))
        open_ = np.flatnonzero(out < 0)
        spot, level = block[open_], 0
        target = np.full(len(open_), -1, np.int64)
        height = np.zeros(len(open_), np.int64)
        todo = np.arange(len(open_))
        while len(todo):  # up: is there a small enough block to the right under the same parent?
            at = spot[todo]
            right = at + 1
            entries = self.levels[level]
            found = (at % 2 == 0) & (right < len(entries))
            found[found] = entries[right[found]] <= goal[open_[todo[found]]]
            target[todo[found]], height[todo[found]] = right[found], level
            todo = todo[~found]
            spot[todo] //= 2
            level += 1
        for level in range(int(height.max(initial=0)), 0, -1):  # down: the left child if it is small enough
            here = np.flatnonzero(height == level)
            left = target[here] * 2
            fits = self.levels[level - 1][left] <= goal[open_[here]]
            target[here] = np.where(fits, left, left + 1)
            height[here] = level - 1
        self._scan(target * PAREN_BLOCK, (target + 1) * PAREN_BLOCK, goal[open_], out, open_)
        return out

    def _scan(self, start: np.ndarray, stop: np.ndarray, goal: np.ndarray, out: np.ndarray, of: np.ndarray) -> None:
        live = np.arange(len(of))
        for step in range(PAREN_BLOCK):
            at = start[live] + step
            live, at = live[at < np.minimum(stop[live], len(self.bits))], at[at < np.minimum(stop[live], len(self.bits))]
            if not len(live):
                return
            hit = self.excess[at] == goal[live]
            out[of[live[hit]]] = at[hit]
            live = live[~hit]

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Leaves between each pair: the rank of `()` behind it less the rank before it."""
        return self._pairs[closes + 1] - self._pairs[opens]


class Minima:
    """Least value of any range, by minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, width = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-width], last[width:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        power = np.frexp((stop - start).astype(float))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][stop[at] - (1 << k)])
        return out


def shared_turns(a: str, b: str) -> int:
    """Turns at the beginning of both paths."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    if a[:high * DIGITS] == b[:high * DIGITS]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle * DIGITS] == b[:middle * DIGITS] else (low, middle - 1)
    return low


def prefix_digests(path: str) -> list[str]:
    """Digest of each prefix of a path, from that of no turn on."""
    running = sha256()
    out = [running.hexdigest()]
    for at in range(0, len(path), DIGITS):
        running.update(path[at:at + DIGITS].encode())
        out.append(running.copy().hexdigest())
    return out


NODE = ("shard string, side string, node string, above string, depth long, conv_id long, parent_conv_id long, own_chars long, n_ends long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long")
_FIELDS = [part.split()[0] for part in NODE.split(", ")]


def shard_nodes(name: str, rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of one shard from its sorted different paths (path, chars of each turn, copies, smallest member).

    Inner nodes are complete; only those below a spine node lack parent_conv_id and have its digest in `above`. Spine nodes have a `side`: b
    for both spines, l or r for one of them; their counts hold what lies inside the shard, without what spine nodes themselves add."""
    bits, depth, chars, ends, least, parent, last_of = [], [], [], [], [], [], []
    stack: list[int] = []
    before = ""
    for path, lengths, copies, member in rows:
        length = len(path) // DIGITS
        same = shared_turns(before, path) if stack else -1
        bits.extend([False] * (len(stack) - 1 - same))
        del stack[same + 1:]
        for d in range(same + 1, length + 1):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(depth))
            depth.append(d)
            chars.append(int(lengths[d - 1]) if d else 0)
            ends.append(0)
            least.append(np.iinfo(np.int64).max)
            bits.append(True)
        ends[stack[-1]] += copies
        least[stack[-1]] = min(least[stack[-1]], member)
        last_of.append(stack[-1])
        before = path
    bits.extend([False] * len(stack))
    n = len(depth)
    tree = Parentheses(np.array(bits, bool))
    opens = np.flatnonzero(tree.bits)
    closes = tree.find_close(opens)
    begin, stop = np.arange(n), np.cumsum(tree.bits)[closes]  # of a subtree, as nodes in preorder
    depth, chars, ends, parent = (np.array(x, np.int64) for x in (depth, chars, ends, parent))
    total = np.concatenate(([0], np.cumsum(ends)))
    convs = total[stop] - total[begin]
    member = Minima(np.array(least, np.int64)).of(begin, stop)
    side = np.full(n, "", "<U1")
    for letter, node in (("l", last_of[0]), ("r", last_of[-1])):
        while node >= 0:
            side[node] = "b" if side[node] not in ("", letter) else letter
            node = parent[node]
    spine = side != ""
    own = np.where(spine, 0, (convs - 1) * chars)
    sums = np.concatenate(([0], np.cumsum(own)))
    saved = sums[stop] - sums[begin]
    closed = np.flatnonzero(spine & (closes == opens + 1))  # spine nodes without a child here may have one elsewhere
    leaves = tree.leaf_pairs(opens, closes) - (np.searchsorted(closed, stop) - np.searchsorted(closed, begin))
    children = np.bincount(parent[(parent >= 0) & ~spine], minlength=n)
    digests: dict[int, str] = {}
    for path, node in ((rows[0][0], last_of[0]), (rows[-1][0], last_of[-1])):
        names = prefix_digests(path)
        while node >= 0:
            digests[node] = names[depth[node]]
            node = parent[node]
    named = {node: sha256(rows[k][0].encode()).hexdigest() for k, node in enumerate(last_of)} | digests
    inner = ~spine & ~spine[np.maximum(parent, 0)]
    arrays = [pa.array([name] * n, pa.string()), pa.array([s or None for s in side.tolist()], pa.string()), pa.array([named.get(k) for k in range(n)], pa.string()),
              pa.array([digests.get(p) for p in parent.tolist()], pa.string()), pa.array(depth), pa.array(member), pa.array(member[np.maximum(parent, 0)], mask=~inner),
              pa.array(chars), pa.array(ends), pa.array(convs), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved)]
    return pa.RecordBatch.from_arrays(arrays, names=_FIELDS)


def _shards(limit: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, before, part = [], 0, 0, "", 0
        for batch in batches:
            for path, lengths, copies, member, part in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held.append((path, lengths, copies, member))
                size += 1 + len(path) // DIGITS - shared_turns(before, path)
                before = path
                if size >= limit:
                    yield shard_nodes(f"{part}.{number}", held)
                    held, size, number, before = [], 0, number + 1, ""
        if held:
            yield shard_nodes(f"{part}.{number}", held)
    return encode


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns: list of (digest, chars) in the order of `turn`, null first; equal numbers by role, then by digest. Rows with a null conv_id take no
    part, repeated rows are turns of their own. The digest covers the lengths, so that no two pairs of role and text share their bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation conv_id - conv_id % every; h is the unsigned CRC-32 of the
    decimal id modulo `most`. A missing base gives no turns. A base is joined with at most 2 * every conversations."""
    bases = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(bases, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def end_digests(paths: DataFrame) -> DataFrame:
    """node, ends_sha256: the SHA-256 of the ascending ids of the conversations that end at a node, comma-joined, from (node, conv_id).

    A node where a third of all conversations end is spread by range of (node, conv_id); each task joins runs of ids, and the
    task of a node streams over these pieces."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            out = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (key != node or len(held) == IDS_PER_PIECE):
                    out.append((node, held[0], ",".join(map(str, held))))
                    held = []
                node = key
                held.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, sha256()
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == node:
                    running.update(b",")
                else:
                    if node is not None:
                        out.append((node, running.hexdigest()))
                    node, running = key, sha256()
                running.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])

    joined = paths.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node string, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def merged_spines(spines: DataFrame) -> DataFrame:
    """One complete row per node on a spine, from what each shard knows of it."""
    whole = spines.groupBy("node", "above", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("own_chars").alias("own_chars"), F.sum("n_ends").alias("n_ends"), F.sum("n_convs").alias("n_convs"),
                                                         F.sum("n_children").alias("inner"), F.min("shard").alias("shard"))
    below = whole.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("spine_children"))
    whole = whole.join(below, "node", "left").withColumn("n_children", F.col("inner") + F.coalesce("spine_children", F.lit(0)))
    whole = stored(whole.drop("inner", "spine_children"))
    # a node's own share counts in one of its shards only: there all its ancestors are on the same spine
    adds = whole.select("node", "shard", ((F.col("n_convs") - 1) * F.col("own_chars")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    rows = spines.select("node", "shard", "side", "depth", "n_leaves", "saved_tokens").join(adds, ["node", "shard"], "left").na.fill(0, ["own", "leaf"])
    deeper = [Window.partitionBy(*keys).orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow) for keys in (("shard",), ("shard", "side"))]
    upto = lambda c: F.when(F.col("side") == "b", F.sum(c).over(deeper[0])).otherwise(F.sum(c).over(deeper[1]))
    sums = rows.select("node", (F.col("n_leaves") + upto("leaf")).alias("n_leaves"), (F.col("saved_tokens") + upto("own")).alias("saved_tokens"))
    sums = sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = whole.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return whole.drop("shard").join(sums, "node").join(parents, "above", "left")


def prefix_trie(conversations: DataFrame, shard_size: int = SHARD_NODES) -> DataFrame:
    """One row per node of the trie over `conversations` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, n_ends. Nothing for an empty table; conversations without a turn end at the root."""
    paths = conversations.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    paths = stored(paths.withColumn("node", F.sha2("path", 256)))
    different = stored(paths.groupBy("path").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("member")))
    ranged = different.repartitionByRange("path").sortWithinPartitions("path").select("path", "chars", "copies", "member", F.spark_partition_id().alias("part"))
    nodes = stored(ranged.mapInArrow(_shards(shard_size), NODE))
    spines = stored(merged_spines(nodes.where("side is not null")))
    inner = nodes.where("side is null")
    tops = inner.where("above is not null")
    hanging = tops.groupBy("above").agg(F.count(F.lit(1)).alias("below"))
    owners = stored(hanging.join(spines.select(F.col("node").alias("above"), F.col("conv_id").alias("_owner")), "above"))
    total = owners.agg(F.sum("below")).first()[0] or 0
    joined = join_heavy(tops, owners, "above", "below", total).withColumn("parent_conv_id", F.col("_owner"))
    columns = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]
    every = inner.where("above is null").select(*columns).unionByName(joined.select(*columns)).unionByName(spines.select(*columns))
    ended = every.where("n_ends > 0").join(end_digests(paths), "node").select(*columns, "ends_sha256")
    return ended.unionByName(every.where("n_ends = 0").withColumn("ends_sha256", F.lit(NO_IDS))).drop("node")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations_of(turns)))


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text, left(sha256(strlen(role) || ':' || role || text), {DIGITS}) AS g
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list({{'g': g, 'n': length(text)}} ORDER BY turn NULLS FIRST, role, g) AS turns, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, CASE WHEN b.turns IS NULL THEN c.turns[c.h + 1:] ELSE b.turns[1:c.h] || c.turns[c.h + 1:] END AS turns
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
n AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, sha256(array_to_string(list_transform(turns[1:depth], lambda t: t.g), '')) AS node,
         CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END AS chars FROM p),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (WHERE ends) AS n_ends,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM n GROUP BY node, depth),
parents AS (SELECT DISTINCT a.node, b.node AS parent FROM n AS a JOIN n AS b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
children AS (SELECT parent, count(*) AS n_children FROM parents GROUP BY parent),
full_nodes AS (SELECT x.*, p.parent, coalesce(k.n_children, 0) AS n_children FROM nodes AS x LEFT JOIN parents AS p USING (node) LEFT JOIN children AS k ON k.parent = x.node),
above AS (SELECT DISTINCT a.node, b.node AS top FROM n AS a JOIN n AS b ON b.conv_id = a.conv_id AND b.depth <= a.depth),
sums AS (
  SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM above JOIN full_nodes USING (node) GROUP BY top)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.n_ends, x.ends_sha256
FROM full_nodes AS x LEFT JOIN nodes AS q ON q.node = x.parent JOIN sums AS s ON s.top = x.node"""
