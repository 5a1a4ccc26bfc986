"""Near-duplicate texts by ProbMinHash over weighted word shingles.

A text is the bag of its five-word shingles, weighted by how often each occurs. Every shingle sends arrivals of a Poisson
process with its weight as rate to random registers, all first arrivals before all second ones, and stops once its next
arrival comes later than the latest register of the text; a register keeps the shingle that arrived first. Two texts agree in
a register with their probability Jaccard similarity, so bands of registers give candidates, and the similarity itself,
computed from the whole bags, decides.

No pair of copies is formed: equal texts share a representative; texts in one bucket are compared with three leaders of the
bucket; then only those outside the largest class of their bucket are compared with the rest of it, in blocks of bounded
size, as products of matrices. That yields the classes of the graph of all similar candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import batch_words, join_heavy, mixed, shingles, stored, texts_of
from bartide.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 5
#: candidates whose registers agree less are dropped before the bags are fetched: more than five standard errors below the threshold
LEAST_AGREEMENT = 0.6
#: texts whose shingles are held as arrays together
TEXTS_AT_ONCE = 400
#: bytes of shingles in one block of a bucket
BLOCK_BYTES = 1 << 20


def bags(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the different shingles of each text, in order of texts and then of shingles."""
    rows, hashes = batch_words(column)
    rows, value, _ = shingles(rows, hashes, width)
    if not len(rows):
        return rows, value, rows.astype(float)
    key = mixed(value ^ mixed(rows.astype(np.uint64)))
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    order = np.lexsort((value[first], rows[first]))
    return rows[first][order], value[first][order], counts[order].astype(float)


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the element that arrives first in each register; 0 for a text without elements."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    row, element, weight, time = rows, elements, weights, np.zeros(len(rows))
    round_ = 0
    while len(row):
        draw = mixed(element + np.uint64((round_ * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1)))
        time = time - np.log(((draw >> np.uint64(24)).astype(float) + 0.5) / 2.0 ** 40) / weight
        go = time < latest[row]
        row, element, weight, time, draw = row[go], element[go], weight[go], time[go], draw[go]
        place = row * registers + (((draw & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
        better = time < earliest[place]
        place, at = place[better], time[better]
        np.minimum.at(earliest, place, at)
        won = earliest[place] == at
        winner[place[won]] = element[better][won]
        if round_ < 8 or round_ % 8 == 0:
            active = np.unique(row)
            latest[active] = earliest.reshape(texts, registers)[active].max(axis=1)
        round_ += 1
    return winner.reshape(texts, registers)


def sign_batches(batches: Iterator[pa.RecordBatch], bands: int, band_rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            rows, value, weight = bags(part.column(1))
            sign = signatures(rows, value, weight, part.num_rows, bands * band_rows)
            some = np.bincount(rows, minlength=part.num_rows) > 0
            sign = sign[some]
            keys = np.zeros((len(sign), bands), np.uint64)
            for k in range(band_rows):
                keys = mixed(keys ^ sign[:, k::band_rows])
            keys = mixed(keys + np.arange(bands, dtype=np.uint64))
            ids = part.column(0).filter(pa.array(some))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sign) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            short = np.ascontiguousarray((sign >> np.uint64(40)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array([r.tobytes() for r in short], pa.binary())], names=["doc_id", "keys", "registers"])


def bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, bag (sorted shingles, four bytes each), weights (four bytes each; null where all are 1)."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            rows, value, weight = bags(part.column(1))
            short = (value >> np.uint64(32)).astype(np.uint32)
            ends = np.cumsum(np.bincount(rows, minlength=part.num_rows))
            bag, weights = [], []
            for low, high in zip(np.concatenate(([0], ends)), ends):
                bag.append(short[low:high].tobytes())
                own = weight[low:high]
                weights.append(None if (own == 1).all() else own.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bag, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "bag", "weights"])


def similarity(a: np.ndarray, v: np.ndarray | None, b: np.ndarray, w: np.ndarray | None) -> float:
    """Probability Jaccard similarity of two bags of sorted elements with weights (None: all 1): the sum over common
    elements i of 1 / sum over all j of max(v_j / v_i, w_j / w_i)."""
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)
    if v is None and w is None:
        return (len(a) + len(b) - len(union)) / len(union)
    x, y = np.zeros(len(union)), np.zeros(len(union))
    np.add.at(x, np.searchsorted(union, a), 1.0 if v is None else v.astype(float))
    np.add.at(y, np.searchsorted(union, b), 1.0 if w is None else w.astype(float))
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(y)))
    above = x.sum() - np.concatenate(([0.0], np.cumsum(x)))
    common = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[common], "left")  # from here on the first bag's share is the larger
    return float((1 / (above[cut] / x[common] + below[cut] / y[common])).sum())


def _whole(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(data, np.uint32)


def agree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose registers agree often enough. Columns a, b, registers of both."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((left == right).mean(axis=1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])


def verify_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs at or over the threshold. Columns a, b, bag and weights of a, bag and weights of b."""
    for batch in batches:
        keep = [similarity(_whole(p), _whole(q), _whole(r), _whole(s)) >= threshold - 1e-12
                for p, q, r, s in zip(*[map(lambda x: x.as_py(), batch.column(i)) for i in (2, 3, 4, 5)])]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def block_links(block: pa.Table, threshold: float) -> pa.Table:
    """One link from each text of the first side to each class of the second side that holds a similar text.

    Probability Jaccard is at most the sum of min(p_i, q_i) of the shares p and q, so at most the sum of sqrt(p_i * q_i): the
    product of the square roots of the weights, which for bags without weights is the number of common shingles. Every
    pair with weights that reaches the threshold there is verified."""
    first = block["first"].to_numpy(zero_copy_only=False)
    sides = [block.filter(pa.array(first)), block.filter(pa.array(~first))]
    if not sides[0].num_rows or not sides[1].num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    bags_ = [[_whole(x) for x in s["bag"].to_pylist()] for s in sides]
    weights = [[_whole(x) for x in s["weights"].to_pylist()] for s in sides]
    sizes = [np.array([len(x) for x in b]) for b in bags_]
    roots = [[np.ones(len(x), np.float32) if w is None else np.sqrt(w, dtype=np.float32) for x, w in zip(b, ws)] for b, ws in zip(bags_, weights)]
    totals = [np.array([float(len(x)) if w is None else float(w.sum(dtype=np.uint64)) for x, w in zip(b, ws)]) for b, ws in zip(bags_, weights)]
    columns = np.unique(np.concatenate(bags_[0]))
    spots = []
    for own, root, size in zip(bags_, roots, sizes):
        flat = np.concatenate(own)
        place = np.searchsorted(columns, flat)
        place[place == len(columns)] = 0
        hit = columns[place] == flat if len(columns) else np.zeros(len(flat), bool)
        spots.append((np.repeat(np.arange(len(own)), size)[hit], place[hit], np.concatenate(root)[hit]))
    n, m = len(bags_[0]), len(bags_[1])
    common = np.zeros((n, m), np.float32)
    tile = max((1 << 23) // max(n, m), 1)
    for low in range(0, len(columns), tile):
        dense = []
        for (r, c, value), rows in zip(spots, (n, m)):
            inside = (c >= low) & (c < low + tile)
            matrix = np.zeros((rows, min(tile, len(columns) - low)), np.float32)
            matrix[r[inside], c[inside] - low] = value[inside]
            dense.append(matrix)
        common += dense[0] @ dense[1].T
    share = common / np.maximum(sizes[0][:, None] + sizes[1][None, :] - common, 1)  # of pairs without weights
    bound = common / np.sqrt(np.maximum(totals[0][:, None] * totals[1][None, :], 1))
    plain = [np.array([w is None for w in ws]) for ws in weights]
    classes = [s["component"].to_numpy() for s in sides]
    ids = [s["doc_id"].to_numpy() for s in sides]
    apart = classes[0][:, None] != classes[1][None, :]
    both_plain = plain[0][:, None] & plain[1][None, :]
    pairs = np.argwhere((share >= threshold - 1e-6) & apart & both_plain)
    _, number = np.unique(classes[1], return_inverse=True)
    _, one = np.unique(pairs[:, 0] * (number.max() + 1) + number[pairs[:, 1]], return_index=True)
    links = {(int(i), int(classes[1][j])): int(j) for i, j in pairs[one]}
    for i, j in np.argwhere((bound >= threshold - 1e-3) & apart & ~both_plain):  # single precision
        key = (int(i), int(classes[1][j]))
        if key not in links and similarity(bags_[0][i], weights[0][i], bags_[1][j], weights[1][j]) >= threshold - 1e-12:
            links[key] = int(j)
    return pa.table({"a": pa.array([ids[0][i] for i, _ in links], pa.int64()), "b": pa.array([ids[1][j] for j in links.values()], pa.int64())})


def _with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of both sides of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), kept (whether it is that one), one row per input row.

    Equal texts are one class; texts whose five-word shingles have a probability Jaccard similarity of `threshold` or more
    are linked, and linked texts are one class. A text of one to four words has one shingle. A null text counts as empty;
    all empty texts are one class; texts of white space only are in one class if equal. Rows that repeat a doc_id are one document."""
    texts = texts_of(docs)
    exact = stored(texts.select("doc_id", F.unhex(F.md5("text")).alias("key")))
    groups = stored(exact.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    signed = texts.mapInArrow(lambda b: sign_batches(b, bands, band_rows), "doc_id long, keys array<long>, registers binary")
    signed = stored(signed.join(groups.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    spread = signed.select("doc_id", F.explode("keys").alias("bucket"))
    leaders = [F.min("doc_id").alias("l1"), F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("l2"), F.min_by("doc_id", F.xxhash64("doc_id", F.lit(2))).alias("l3")]
    buckets = stored(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *leaders).where("rows > 1"))
    members = stored(join_heavy(spread, buckets, "bucket", "rows", signed.count() * bands))
    pairs = members.select("doc_id", F.explode(F.array("l1", "l2", "l3")).alias("leader")).where("doc_id <> leader")
    pairs = pairs.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    pairs = stored(_with(pairs, signed, ["registers"]).select("a", "b", "registers_a", "registers_b").mapInArrow(agree_batches, "a long, b long"))

    # the bags of texts that may be similar to another: those of the pairs left and those that are left to compare in blocks
    rest = members.where("rows > 2 and doc_id not in (l1, l2, l3)")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(rest.select("doc_id")).distinct()
    contents = stored(texts.join(wanted, "doc_id", "left_semi").mapInArrow(bag_batches, "doc_id long, bag binary, weights binary").dropDuplicates(["doc_id"]))
    verified = _with(pairs, contents, ["bag", "weights"]).select("a", "b", "bag_a", "weights_a", "bag_b", "weights_b")
    links = stored(verified.mapInArrow(lambda b: verify_batches(b, threshold), "a long, b long"))
    first = components(links)

    # buckets in which texts that are no leaders belong to several classes
    placed = rest.select("bucket", "doc_id").join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = stored(placed.join(contents.select("doc_id", F.octet_length("bag").alias("bytes")), "doc_id"))
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark"))
    mixed_ = shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max_by("component", F.struct("n", "component")).alias("largest"),
                                         F.sum("n").alias("n"), F.sum("mark").alias("mark"), F.sum("bytes").alias("bytes"), F.max("n").alias("most")).where("classes > 1")
    mixed_ = mixed_.groupBy("n", "mark").agg(F.min(F.struct("bucket", "largest", "bytes")).alias("m")).select("n", "m.*")  # buckets of the same texts are one
    mixed_ = stored(mixed_.withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("int")).drop("bytes"))
    inside = join_heavy(placed, mixed_, "bucket", "n", placed.count()).select("bucket", "doc_id", "component", "blocks", (F.col("component") != F.col("largest")).alias("outside"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    firsts = inside.where("outside").select("bucket", "doc_id", "component", F.lit(True).alias("first"), block.alias("i"), every.alias("j"))
    seconds = inside.select("bucket", "doc_id", "component", F.lit(False).alias("first"), block.alias("j"), every.alias("i")).select("bucket", "doc_id", "component", "first", "i", "j")
    both = firsts.union(seconds).join(contents, "doc_id")
    more = both.groupBy("bucket", "i", "j").applyInArrow(lambda t: block_links(t, threshold), "a long, b long")
    classes = components(links.union(stored(more)))

    named = groups.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "copies", F.coalesce("component", "doc_id").alias("class_id"))
    return join_heavy(exact, stored(named), "key", "copies", exact.count()).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
