"""A Merkle manifest of a dataset: digests of rows, a ternary tree for each source, a tree over the sources, and proofs.

Leaves are numbered inside their source after one sort by range, whose hot sources and hot rows spread over partitions. BLOCK
consecutive leaves are a superblock: a task reduces it to its top node, the top nodes are reduced in the same way until each
source has one node, and the subroots of all sources likewise. On the way down every superblock gets its outer nodes, the siblings
above its top node. Leaves and outer nodes are then cogrouped by superblock: one task rebuilds the local tree, joins the
local and the outer siblings of each leaf and folds the proof.

A node is the lowercase hex SHA-256 of its inputs joined; digests go in as hex text. Null doc_ids come first, rows of equal
doc_id are ordered by their leaf, so repeated rows are leaves of their own; a null doc_id is never tampered. An empty table has
no nodes. Columns beyond the hashed ones take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import crc32_sql, stored

FAN = 3
#: levels of a superblock
LEVELS = 7
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, tree (source as a key that orders nulls first), leaf, found (the leaf of the row as it is met later: every other
    id has lost the line ends of its text)."""
    columns = [F.col(f"`{c}`").cast("string" if c in ("source", "lang", "text") else "long") for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0, F.lit(False))
    later = F.when(hit, F.replace(columns[-1], F.lit("\n"), F.lit(""))).otherwise(columns[-1])
    key = F.when(columns[1].isNull(), "").otherwise(F.concat(F.lit("="), columns[1]))
    return docs.select(columns[0].alias("doc_id"), key.alias("tree"), leaf_digest(*columns).alias("leaf"), leaf_digest(*columns[:-1], later).alias("found"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with `local`: how many rows before them in this partition have the same first column."""
    last, seen = None, 0
    for batch in batches:
        out = []
        for key in batch.column(0).to_pylist():
            seen = seen + 1 if key == last else 0
            last = key
            out.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "local"])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` (a stored table, `group` is never null) with `place`, counted from 0 in each group by `order`.

    One exchange by range of (group, order, place in the files), so that neither a hot group nor many equal rows meet in one
    task. A group goes on from one partition to the next, so only the first group of a partition has rows elsewhere before
    it: one number per partition is broadcast."""
    sort = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    columns = [group, *[c for c in rows.columns if c != group]]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", part int, local long"
    counted = stored(ranged.select(*columns, F.spark_partition_id().alias("part")).mapInArrow(_counted, schema))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("part", group).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    firsts = sizes.groupBy("part").agg(F.min(group).alias("_first"), F.min_by("before", group).alias("before"))
    place = F.col("local") + F.when(F.col(group) == F.col("_first"), F.col("before")).otherwise(0)
    return counted.join(F.broadcast(firsts), "part").select(*rows.columns, place.alias("place"))


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """All levels from `nodes` up to a single node; with `height` exactly so many levels above them."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([parent(last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands to the left and to the right of the node's ancestor in its run, on each level below the top."""
    left, right = [], []
    for level in levels[:-1]:
        first = at - at % FAN
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1:first + FAN]))
        at //= FAN
    return left, right


def folded(node: str, left: list[str], right: list[str]) -> str:
    for before, after in zip(left, right):
        node = sha256((before + node + after).encode()).hexdigest()
    return node


def _lifted(rows: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
    """The nodes of a superblock in order, and whether its tree has more nodes than one on this level. If so, the last node, the
    top of a shorter superblock, is brought to the height of the others."""
    rows = rows.sort_values("place")
    several = len(rows) > 1 or int(rows["place"].iloc[0]) > 0
    if several:
        rows["node"] = [levels_of([node], height)[-1][0] for node, height in zip(rows["node"], rows["short"])]
    return rows, several


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    """tree, place, node, short (levels that the top lies below the tops of full superblocks)."""
    rows, several = _lifted(rows)
    levels = levels_of(rows["node"].tolist())
    short = LEVELS - (len(levels) - 1) if several else 0
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [int(rows["place"].iloc[0]) // BLOCK], "node": [levels[-1][0]], "short": [short]})


OUTER = "tree string, block long, deep boolean, left array<string>, right array<string>, subroot string, root string"


def _open(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """From the nodes of a superblock and its outer nodes: the outer nodes of every superblock below it."""
    nodes, several = _lifted(nodes)
    above = outer.iloc[0]
    levels = levels_of(nodes["node"].tolist(), LEVELS if above["deep"] else None)
    paths = [siblings(levels, at) for at in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "block": nodes["place"], "deep": several, "left": [left + list(above["left"]) for left, _ in paths],
                         "right": [right + list(above["right"]) for _, right in paths], "subroot": above["subroot"], "root": above["root"]})


def _prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The rows of a superblock with their proofs and what these fold to."""
    leaves = leaves.sort_values("place")
    above = outer.iloc[0]
    levels = levels_of(leaves["leaf"].tolist(), LEVELS if above["deep"] else None)
    proofs, tops = [], []
    for at, found in enumerate(leaves["found"]):
        left, right = siblings(levels, at)
        left, right = left + list(above["left"]), right + list(above["right"])
        proofs.append(sha256("".join(a + b for a, b in zip(left, right)).encode()).hexdigest())
        tops.append(folded(found, left, right))
    return pd.DataFrame({"doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": tops,
                         "verified": [t == above["root"] for t in tops]})


def blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK))


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """The tables of tops, level by level, until each tree has one node: (tree, place, node, short)."""
    tables = []
    while True:
        nodes = stored(blocks(nodes).groupBy("tree", "block").applyInPandas(_top, "tree string, place long, node string, short long"))
        tables.append(nodes)
        if (nodes.agg(F.max("place")).first()[0] or 0) == 0:
            return tables


def opened(tables: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The outer nodes of the superblocks of the first table's nodes, from those of the last table's (OUTER)."""
    for nodes in reversed(tables):
        outer = blocks(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_open, OUTER)
    return outer


def manifest(leaves: DataFrame) -> DataFrame:
    """`leaves`: doc_id, tree, leaf and found (see leaves_of). The rows with subroot, root, proof_sha256, folded_root and verified."""
    placed = stored(numbered(stored(leaves), "tree", ["doc_id", "leaf"]))
    trees = reduced(placed.select("tree", "place", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("short")))
    subroots = stored(trees[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "node"))
    ordered = stored(numbered(subroots, "tree", ["name"]).withColumn("short", F.lit(0).cast("long")))
    over = reduced(ordered.select("tree", "place", "node", "short"))
    none = F.array().cast("array<string>")
    top = over[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(False).alias("deep"), none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    # the nodes of `ordered` are opened once more than its tops, which gives the path of every subroot
    paths = opened([ordered.select("tree", "place", "node", "short"), *over], top).withColumnRenamed("block", "place").drop("tree", "subroot", "deep")
    outer = ordered.join(paths, "place").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("deep"), "left", "right", F.col("node").alias("subroot"), "root")
    outer = stored(opened(trees, outer))
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = blocks(placed).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make a nullable long a double
    proved = rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_prove, schema)
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def dataset_manifest(docs: DataFrame) -> DataFrame:
    return manifest(leaves_of(docs))


def _sql() -> str:
    joined = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in (*FIELDS[:-1], text)) + ")"
    up = lambda table, start: f"""{start}  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM {table} WHERE n > 1 GROUP BY tree, level, place // 3"""  # noqa: E731
    beside = lambda table: f"""string_agg(s.node, '' ORDER BY s.place) FILTER (WHERE s.place < a.own) AS before, string_agg(s.node, '' ORDER BY s.place) FILTER (WHERE s.place > a.own) AS after
  FROM a JOIN {table} AS s ON s.tree = a.tree AND s.level = a.level AND s.place // 3 = a.own // 3 AND s.n > 1"""  # noqa: E731
    return f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later FROM documents),
leaves AS (SELECT doc_id, tree, {joined("text")} AS leaf, {joined("later")} AS found FROM raw),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS rid,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS ({up("nodes", "SELECT tree, 0 AS level, place, leaf AS node, n FROM placed")}),
subroots AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS ({up("tops", "SELECT '' AS tree, 0 AS level, place, node, n FROM subroots")}),
own_levels AS (SELECT rid, tree, unnest(range(20)) AS level, place FROM placed),
a_low AS (SELECT rid, tree, level, place // CAST(3 ** level AS BIGINT) AS own FROM own_levels),
low AS (SELECT a.rid, a.level, {beside("nodes").replace("FROM a ", "FROM a_low AS a ")} GROUP BY a.rid, a.level),
a_high AS (SELECT name, '' AS tree, level, place // CAST(3 ** level AS BIGINT) AS own FROM (SELECT name, place, unnest(range(20)) AS level FROM subroots)),
high AS (SELECT a.name, a.level, {beside("tops").replace("FROM a ", "FROM a_high AS a ")} GROUP BY a.name, a.level),
paths AS (SELECT rid, level, before, after FROM low UNION ALL SELECT p.rid, 100 + h.level, h.before, h.after FROM placed AS p JOIN high AS h ON h.name = p.tree),
steps AS (SELECT rid, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY rid ORDER BY level) AS step FROM paths),
folds AS (
  SELECT rid, 0 AS step, found AS node FROM placed UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.before || f.node || s.after) FROM folds AS f JOIN steps AS s ON s.rid = f.rid AND s.step = f.step + 1),
folded AS (SELECT rid, arg_max(node, step) AS folded_root FROM folds GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, r.node AS subroot, t.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.node AS verified
FROM placed AS p JOIN subroots AS r ON r.name = p.tree JOIN tops AS t ON t.n = 1 JOIN folded AS f ON f.rid = p.rid LEFT JOIN proofs AS q ON q.rid = p.rid"""


SQL = _sql()
