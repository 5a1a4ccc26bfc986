"""Language of a text by compression: the language whose dictionary makes the text smallest.

Each language has one raw-content dictionary: the words that occur in most of its training texts, the most frequent ones last,
where the distances to them are shortest. A text is put in lower case, everything but letters becomes one blank, and it is
encoded in blocks of BLOCK_BYTES, each with the dictionary of each language, so that a long text cannot become its own
dictionary and memory stays bounded. The sum of the encoded sizes decides; a narrow margin to the next language is a rejection.

Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Equal sizes go to the language with
more training texts, then to the smaller name. Rows that repeat a doc_id are judged row by row; a null doc_id is never held out; further columns
take no part. Python's and zstandard's Unicode tables decide what a letter is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import id_remainder, stored

#: most different texts of a language that its dictionary is made from: those of the lowest hash
SAMPLE_TEXTS = 2_000
#: bytes of a dictionary
DICTIONARY_BYTES = 1 << 15
#: most languages; more is an error, because every worker holds all dictionaries
MOST_LANGUAGES = 256
#: longer words are left out of a dictionary
LONGEST_WORD = 40
BLOCK_BYTES = 4096
#: share of the best size by which the second one must be larger
LEAST_MARGIN = 0.02
#: weight of a byte of difference in the score
BYTE_WEIGHT = 0.5
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
SETTINGS = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 4, "window_log": 18, "chain_log": 17, "hash_log": 16, "search_log": 3, "target_length": 16,
            "write_content_size": False, "write_checksum": False, "write_dict_id": False}
Model = list[tuple[str, bytes]]


def plain_letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, texts): in how many texts of the batch a word occurs."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, word) for word in set(plain_letters(text).decode().split()) if len(word.encode()) <= LONGEST_WORD)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "texts"])


def training_words(labelled: DataFrame, sample: int = SAMPLE_TEXTS) -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, texts) over the sample of each language in `labelled` (lang, text), and the number of different texts of each
    language. Equal texts of a language count once; the driver sees one row per language."""
    known = labelled.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("digest"))
    different = stored(known.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("rows")))
    totals = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    chosen = different.select("lang", "digest", place.alias("place")).where(F.col("place") <= sample).select("lang", "digest")
    # at most `sample` hashes of a language; equal texts meet again, so one of each is taken
    texts = known.join(F.broadcast(chosen), ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("text").alias("text"))
    counts = texts.select("lang", "text").mapInArrow(_words, "lang string, word string, texts long")
    return counts.groupBy("lang", "word").agg(F.sum("texts").alias("texts")), totals


def fit(labelled: DataFrame, sample: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> Model:
    """(language, dictionary), in the order in which ties are settled."""
    words, totals = training_words(labelled, sample)
    order = Window.partitionBy("lang").orderBy(F.desc("texts"), "word")
    placed = words.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size // 2)
    running = placed.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("bytes") <= size)
    lists = {r["lang"]: [p["word"] for p in sorted(r["found"], key=lambda p: -p["place"])] for r in running.groupBy("lang").agg(F.collect_list(F.struct("place", "word")).alias("found")).collect()}
    return [(lang, " ".join(lists[lang]).encode()) for lang in sorted(lists, key=lambda k: (-totals[k], k))]


class Encoders:
    """One compressor with a prepared dictionary for each language."""

    def __init__(self, model: Model) -> None:
        self.names = [name for name, _ in model]
        settings = zstandard.ZstdCompressionParameters(**SETTINGS)
        self.encoders = []
        for _, content in model:
            if len(content) < 8:  # zstandard takes no smaller dictionary
                self.encoders.append(zstandard.ZstdCompressor(compression_params=settings))
                continue
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=settings)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=settings))

    def sizes(self, letters: bytes) -> list[int]:
        blocks = [letters[i:i + BLOCK_BYTES] for i in range(0, len(letters), BLOCK_BYTES)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]


def judged(sizes: list[int]) -> tuple[int, float, float]:
    """(number of the best, score, margin to the second)."""
    best = int(np.argmin(sizes))
    others = [s for k, s in enumerate(sizes) if k != best]
    margin = (min(others) - sizes[best]) / max(sizes[best], 1) if others else 1.0
    return best, float(1.0 / np.exp(-BYTE_WEIGHT * (np.array(sizes, float) - sizes[best])).sum()), float(margin)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred (smallest size), score, margin, rejected (margin below LEAST_MARGIN) of every row."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(model)
        for batch in batches:
            names, scores, margins = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                if not model or not has_letter(text):
                    best, score, margin = None, 0.0, 0.0
                else:
                    best, score, margin = judged(encoders.sizes(plain_letters(text)))
                names.append(UNKNOWN if best is None else encoders.names[best])
                scores.append(score)
                margins.append(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()),
                                              pa.array([m < LEAST_MARGIN for m in margins], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def language_ids(docs: DataFrame) -> DataFrame:
    """Fitted on the rows that are not held out, applied to all."""
    labelled = docs.where(id_remainder(4) != 2).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return languages(docs, fit(labelled))
