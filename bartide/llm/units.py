"""Substring deduplication by hashes of lines and the clauses in them.

A text is cut into lines and these at the marks that end sentences and clauses, because a repeated passage often begins and ends in the middle of
a sentence; the cut parts, with their places in the text, are the units, and what a passage loses at its ragged ends is less than a clause. Normalised units are grouped by digest over the whole corpus; the
occurrence of the lowest (doc_id, place) stays. The others are copies; a run of copies that follow each other is
removed if it has at least `min_words` words, so that clauses which recur by chance stay where they are.

A passage of few long clauses shares too few whole units. `repeated_windows`
finds those by windows of words instead, whatever the sentences are; the pipeline, whose units are sentences, runs it on what the first rule has left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import batch_words, columns_of, free_name, join_heavy, mixed, shingles, stored, text_buffers, texts_of

#: words in a run of copies from which on it is removed, if units end at clauses
MIN_WORDS = 20
CLAUSES = ".!?,;:"
#: the same for units that end at sentences only: fewer units, so less to shuffle, with larger ragged ends
SENTENCE_WORDS = 28
SENTENCES = ".!?"
#: words of a window that no later document may share
WINDOW_WORDS = 51
#: words of an anchor; every window shares an anchor with all its copies
ANCHOR_WORDS = 16
#: texts whose words are held as arrays together
TEXTS_AT_ONCE = 400
#: more than the code points of any text
_STARTS = 10**12
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def unit_pattern(marks: str) -> re.Pattern:
    return re.compile(rf"[^\n{marks}]*(?:\n|[{marks}]+|\Z)")


def cut_units(text: str, marks: str = CLAUSES) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit with a word, in code points; a unit ends with a line, sentence or clause."""
    out = []
    for m in unit_pattern(marks).finditer(text):
        words = _WORD.findall(m[0])
        if words:
            out.append((m.start(), m.end(), len(words), hashlib.md5(" ".join(words).lower().encode("utf-8", "surrogatepass")).digest()))
    return out


def unit_batches(batches: Iterator[pa.RecordBatch], marks: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "unit", "start", "end", "words", "digest"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.extend((doc_id, i, *unit) for i, unit in enumerate(cut_units(text.as_py(), marks)))
            if len(rows) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, marks: str = CLAUSES) -> DataFrame:
    """The removed runs: doc_id, start, end (code points of the text), n_units, n_words, first_doc_id and first_start (the
    kept occurrence of the run's first unit). Documents without one have no row.

    A null text has no units; rows without a doc_id can't be addressed and take no part. Rows that repeat a doc_id with one
    text are one document: among their equal places none counts as a copy of another. Units are compared in lower case with
    white space collapsed."""
    texts = texts_of(docs).where("doc_id is not null")
    units = stored(texts.mapInArrow(lambda b: unit_batches(b, marks), "doc_id long, unit int, start long, end long, words int, digest binary"))
    # doc_id and start as one number, whose minimum is a hash aggregate
    place = (F.col("doc_id").cast("decimal(19,0)") * F.lit(_STARTS).cast("decimal(13,0)") + F.col("start").cast("decimal(12,0)")).cast("decimal(38,0)")
    firsts = units.groupBy("digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    start = F.pmod("place", F.lit(_STARTS).cast("decimal(38,0)"))
    firsts = stored(firsts.select("digest", ((F.col("place") - start) / _STARTS).cast("long").alias("first_doc_id"), start.cast("long").alias("first_start"), "n"))
    copies = join_heavy(units, firsts, "digest", "n", units.count()).where("not (doc_id = first_doc_id and start = first_start)")
    copies = copies.drop("digest", "n").repartition("doc_id").distinct()
    # copies that follow each other: their number less their rank stays the same
    order = Window.partitionBy("doc_id").orderBy("unit")
    runs = copies.withColumn("run", F.col("unit") - F.row_number().over(order))
    head = F.min_by(F.struct("first_doc_id", "first_start"), "unit").alias("head")
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").cast("long").alias("n_words"), head)
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "start", "end", "n_units", "n_words", "head.first_doc_id", "head.first_start")


def _anchors(rows: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, value, number of the first word) of the anchors: the least values of each `words - ANCHOR_WORDS + 1`
    neighbouring windows of ANCHOR_WORDS words. Equal runs of `words` words have equal values, so an anchor in common."""
    own, value, first = shingles(rows, hashes, ANCHOR_WORDS)
    width = words - ANCHOR_WORDS + 1
    if len(value) < width:
        return own[:0], value[:0], first[:0]
    least, span = value, 1
    while span < width:  # minima of ever longer stretches
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = np.isin(value, least)
    return own[chosen], value[chosen], first[chosen]


def anchor_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The different anchors of each text."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            own, value, _ = _anchors(*batch_words(pc.utf8_lower(part.column(1))), words)
            pairs = np.unique(np.stack((own.astype(np.uint64), value)), axis=1) if len(own) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["doc_id", "anchor"])


def window_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Every window of `words` words that contains one of the text's listed anchors. Columns doc_id, text, anchors."""
    for batch in batches:
        for i in range(batch.num_rows):
            column = batch.column(1).slice(i, 1)
            rows, hashes = batch_words(pc.utf8_lower(column))
            n = len(rows) - words + 1
            if n < 1:
                continue
            _, value, first = shingles(rows, hashes, ANCHOR_WORDS)
            anchors = batch.column(2)[i].values.to_numpy().view(np.uint64)
            edge = np.zeros(len(rows) + 1, np.int64)
            spots = first[np.isin(value, anchors)]
            np.add.at(edge, np.maximum(spots - (words - ANCHOR_WORDS), 0), 1)
            np.add.at(edge, spots + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            if not len(at):
                continue
            sums = [shingles(rows, h, words)[1][at] for h in (hashes, mixed(hashes))]
            digest = np.stack(sums, axis=1).tobytes()
            _, _, begins, ends = batch_words(column, spans=True)  # lower case has the same words, but maybe other bytes
            places, data = text_buffers(column)
            points = np.cumsum((data[places[0]:places[1]] & 0xC0) != 0x80)  # code points up to a byte and with it
            start = points[begins[at] - places[0]] - 1
            end = points[ends[at + words - 1] - places[0] - 1]
            for k in range(0, len(at), 100_000):
                part = slice(k, k + 100_000)
                m = len(at[part])
                digests = pa.array([digest[16 * j:16 * j + 16] for j in range(k, k + m)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch.column(0)[i].as_py())), pa.array(at[part]), pa.array(start[part]), pa.array(end[part]), digests],
                                                 names=["doc_id", "word", "start", "end", "digest"])


def repeated_windows(docs: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, start, end (code points) of the longest runs whose every word is in a window of `words` words that a document
    of a lower doc_id has, wherever its sentences begin and end.

    Anchors that two documents share tell where such a window may be; only there all windows are written and grouped by
    digests of 128 bits. Words are compared in lower case. Rows without a doc_id take no part."""
    texts = texts_of(docs).where("doc_id is not null")
    anchors = stored(texts.mapInArrow(lambda b: anchor_batches(b, words), "doc_id long, anchor long"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = stored(shared.select("anchor", "n"))
    lists = join_heavy(anchors, shared, "anchor", "n", anchors.count()).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = texts.join(lists, "doc_id").select("doc_id", "text", "anchors").mapInArrow(lambda b: window_batches(b, words), "doc_id long, word long, start long, end long, digest binary")
    windows = stored(windows)
    firsts = windows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first_doc_id < last")
    firsts = stored(firsts.drop("last"))
    copies = join_heavy(windows, firsts, "digest", "n", windows.count()).where("doc_id > first_doc_id").select("doc_id", "word", "start", "end").repartition("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("word")
    copies = copies.withColumn("fresh", F.coalesce((F.col("word") - F.lag("word").over(order) > words).cast("int"), F.lit(0)))
    return copies.withColumn("run", F.sum("fresh").over(order)).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the spans (doc_id, start, end) cut from the text; other columns stay. Texts without a span stay as they are."""
    name = free_name(docs, "spans")
    lists = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))
    return docs.join(lists, "doc_id", "left").withColumn("text", cut_text(F.col("text"), F.col(name))).select(columns_of(docs))


def cut_text(text: Column, spans: Column) -> Column:
    """`text` without sorted, disjoint [start, end) spans; null spans leave it as it is."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(edges, ends, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(spans.isNull(), text).otherwise(F.array_join(kept, ""))


SQL = rf"""
WITH numbered AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, regexp_extract_all(text, '[^\n.!?,;:]*(?:\n|[.!?,;:]+)|[^\n.!?,;:]+') AS list FROM numbered),
spread AS (
  SELECT doc_id, unnest(list) AS part, generate_subscripts(list, 1) AS i FROM parts),
placed AS (
  SELECT doc_id, i, part, sum(len(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM spread),
units AS (
  SELECT doc_id, e - len(part) AS s, e, len(words) AS words, lower(array_to_string(words, ' ')) AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit
  FROM (SELECT *, regexp_extract_all(part, '[^\x20\x09-\x0D]+') AS words FROM placed) WHERE len(words) > 0),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(s) OVER w AS first_start FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id, s)),
copies AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE NOT (doc_id = first_doc_id AND s = first_start))
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
       arg_min(first_doc_id, unit) AS first_doc_id, CAST(arg_min(first_start, unit) AS BIGINT) AS first_start
FROM copies GROUP BY doc_id, run HAVING sum(words) >= {MIN_WORDS}"""
