"""Quality rules whose cutoffs are chosen under a controlled risk.

Every rule is a number that grows with badness. For each rule, stratum (language) and cutoff of a fixed grid, the labelled good
documents that the cutoff would reject are counted. A cutoff may be used if, at a false-rejection rate as high as the allowed
one, so few rejections would come about with a probability of at most delta / tests (exact binomial tail; Bonferroni over all
tests). Among those the one that rejects most labelled bad documents is used. So with probability 1 - delta no stratum loses
more than `risk` of its good documents to the rules together. Where labels are too few to show that, a rule rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import columns_of, join_heavy, stored

GAP = r"\\x20\\x09-\\x0D"
#: the grid of each rule and its value; values are null-safe by greatest(.., 1)
SHARES = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8]
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", SHARES),
    "capitals": ("n_capitals / greatest(word_chars, 1)", SHARES),
    "shouts": ("n_shouts / greatest(n_words, 1)", SHARES),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", SHARES),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", SHARES),
    "long_words": ("word_chars / greatest(n_words, 1)", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0, 40.0]),
}
RISK = 0.05
DELTA = 0.05
MIN_WORDS = 50


def measured(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the counts of each whole text and the columns to carry; a null text has none. All built-in expressions, no shuffle."""
    step = docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    step = step.select(*carried, "doc_id", "lang", F.expr(f"array_remove(split(text, '[{GAP}]+'), '')").alias("words"),
                       F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^{GAP}]')").alias("lines"),
                       F.expr("length(text) - length(regexp_replace(text, '[#*$%&|<>]', ''))").alias("n_symbols"),
                       F.expr(r"length(text) - length(regexp_replace(text, '\\p{Lu}', ''))").alias("n_capitals"),
                       F.expr("length(text) - length(regexp_replace(text, '[!?]', ''))").alias("n_shouts"), F.xxhash64("text").alias("text_hash"))
    step = step.select(*carried, "doc_id", "lang", "text_hash", "words", "n_symbols", "n_capitals", "n_shouts", F.expr("size(words)").alias("n_words"),
                       F.expr("length(array_join(words, ''))").alias("word_chars"), F.expr("size(lines)").alias("n_lines"),
                       F.expr("size(lines) - size(array_distinct(lines))").alias("n_dup_lines"),
                       F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    # three-word windows as hashes with the position in the low bits: one sort of longs brings equal windows together; as the position
    # takes bits from the hash, neighbours are compared word by word
    step = step.withColumn("pos_bits", F.expr("cast(floor(log2(n_words + 1)) + 1 as int)"))
    step = step.withColumn("sorted", F.expr("""
        if(n_words < 3, cast(array() as array<bigint>), sort_array(zip_with(
            slice(zip_with(zip_with(hashes, slice(hashes, 2, greatest(n_words - 1, 1)), (a, b) -> xxhash64(a, b)),
                           slice(hashes, 3, greatest(n_words - 2, 1)), (p, c) -> xxhash64(p, c)), 1, greatest(n_words - 2, 0)),
            sequence(0, greatest(n_words - 3, 0)), (x, i) -> shiftleft(x, pos_bits) | cast(i as bigint))))"""))
    step = step.withColumn("found", F.expr("""
        flatten(filter(zip_with(sorted, slice(sorted, 2, greatest(size(sorted) - 1, 0)),
                                (a, b) -> if(shiftrightunsigned(a ^ b, pos_bits) = 0
                                             and slice(words, cast(a & (shiftleft(1L, pos_bits) - 1) as int) + 1, 3) = slice(words, cast(b & (shiftleft(1L, pos_bits) - 1) as int) + 1, 3),
                                             array(a, b), null)), x -> x is not null))"""))
    step = step.withColumn("n_repeat_words", F.expr("""
        size(array_distinct(flatten(transform(array_distinct(found), x -> transform(sequence(0L, 2L),
             k -> (x & (shiftleft(1L, pos_bits) - 1)) + k)))))"""))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
    return step.select(*carried, "doc_id", "lang", "text_hash", *[F.col(c).cast("long").alias(c) for c in counts])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def allowed_rejections(n: str, rate: float, level: str) -> Column:
    """The largest k for which at most k rejections among n have a probability of at most `level` at `rate`; -1 if there is none."""
    return F.expr(f"""
        aggregate(sequence(0L, cast(floor({n} * {rate!r}D) as bigint)),
            named_struct('term', {n} * ln(1D - {rate!r}D), 'total', 0D, 'best', -1L),
            (s, i) -> named_struct('term', s.term + ln(greatest({n} - i, 1) / cast(i + 1 as double)) + ln({rate!r}D / (1D - {rate!r}D)),
                                   'total', s.total + exp(s.term), 'best', if(s.total + exp(s.term) <= {level}, i, s.best)),
            s -> s.best)""")


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """lang, rule, cutoff: the cutoffs in use. `labelled` has lang, the counts and good (boolean).

    One row per stratum is aggregated, whatever the number of labels; a stratum without a safe cutoff has no row."""
    tests = [(rule, value, at) for rule, (value, grid) in RULES.items() for at in grid]
    sums = [F.sum(F.expr(f"cast(good and {value} > {at!r}D as bigint)")).alias(f"g{i}") for i, (_, value, at) in enumerate(tests)]
    sums += [F.sum(F.expr(f"cast(not good and {value} > {at!r}D as bigint)")).alias(f"b{i}") for i, (_, value, at) in enumerate(tests)]
    strata = labelled.groupBy("lang").agg(F.sum(F.expr("cast(good as bigint)")).alias("n_good"), *sums)
    number = strata.agg(F.count(F.lit(1)).alias("strata"))
    level = f"({delta!r}D / (strata * {len(tests)}))"
    strata = strata.crossJoin(F.broadcast(number)).withColumn("allowed", allowed_rejections("n_good", risk / len(RULES), level))
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(at).alias("cutoff"), F.col(f"g{i}").alias("false_rejections"), F.col(f"b{i}").alias("rejections"))
                     for i, (rule, _, at) in enumerate(tests)])
    flat = strata.select("lang", "allowed", F.explode(rows).alias("r")).select("lang", "allowed", "r.*")
    safe = flat.where((F.col("false_rejections") <= F.col("allowed")) & (F.col("rejections") > 0))
    return safe.groupBy("lang", "rule").agg(F.max(F.struct("rejections", "cutoff")).alias("m")).select("lang", "rule", F.col("m.cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and failed_rules (names joined by commas, empty if none).

    Labels with a null id or quality take no part. Equal texts of a language with equal labels are one trial, however many documents and
    labels there are, because the bound is for independent ones; a text labelled both ways is one of each. A null language is
    the stratum ''. Null and empty texts fail the base rule. One row per input row; an empty table gives an empty result."""
    rows = stored(measured(docs))
    limits, total = limits_of(rows, labels, risk, delta)
    verdict = join_heavy(rows, limits, "lang", "rows_of_lang", total).withColumn("base_failed", base_failed()).withColumn("failed_rules", failed_rules())
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                          (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")


def limits_of(rows: DataFrame, labels: DataFrame, risk: float, delta: float) -> tuple[DataFrame, int]:
    """(lang, rows_of_lang and the cutoff of each rule or null, number of rows) of stored counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("doc_id is not null and good is not null")
    chosen = cutoffs(rows.join(marks, "doc_id").dropDuplicates(["lang", "text_hash", "good"]), risk, delta)
    limits = chosen.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"at_{r}") for r in RULES])
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows_of_lang"))
    limits = stored(sizes.join(limits, "lang", "left"))
    return limits, limits.agg(F.sum("rows_of_lang")).first()[0] or 0


def failed_rules() -> Column:
    return F.concat_ws(",", *[F.when(F.expr(f"{value} > at_{rule}"), F.lit(rule)) for rule, (value, _) in RULES.items()])


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of `docs`, with all columns, that `judged` keeps. The texts are not shuffled: they are measured a second time
    against the cutoffs."""
    limits, total = limits_of(stored(measured(docs)), labels, risk, delta)
    at = [f"at_{r}" for r in RULES]
    whole = docs.select(F.struct(*columns_of(docs)).alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    limited = join_heavy(whole, limits, "lang", "rows_of_lang", total).select("row", "row.doc_id", "row.text", "lang", *at)
    # the filter names the counts many times; a column that isn't deterministic keeps it above the step that computes them
    rows = measured(limited, ("row", *at)).withColumn("barrier", F.monotonically_increasing_id())
    return rows.where((F.col("barrier") >= 0) & ~base_failed() & (failed_rules() == "")).select("row.*")


def _sql() -> str:
    """The same in DuckDB: windows are compared as words, the binomial tail is a running sum."""
    tests = [(i, rule, value, at) for i, (rule, value, at) in enumerate((r, v, a) for r, (v, g) in RULES.items() for a in g)]
    counted = " UNION ALL ".join(
        f"SELECT lang, {i} AS test, '{rule}' AS rule, CAST({at!r} AS DOUBLE) AS cutoff, sum(CASE WHEN good AND {value.replace(' / ', '::DOUBLE / ')} > {at!r}::DOUBLE THEN 1 ELSE 0 END) AS g, "
        f"sum(CASE WHEN NOT good AND {value.replace(' / ', '::DOUBLE / ')} > {at!r}::DOUBLE THEN 1 ELSE 0 END) AS b FROM labelled GROUP BY lang" for i, rule, value, at in tests)
    rate = RISK / len(RULES)
    failing = ", ".join(f"CASE WHEN {value.replace(' / ', '::DOUBLE / ')} > at_{rule} THEN '{rule}' END" for rule, (value, _) in RULES.items())
    limits = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS at_{r}" for r in RULES)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT row_id, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
spots AS (
  SELECT row_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT row_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM cut)),
twice AS (SELECT row_id, a, b, c FROM spots GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT spots.row_id, unnest([i, i + 1, i + 2]) AS p FROM spots JOIN twice USING (row_id, a, b, c)) GROUP BY row_id),
measured AS (
  SELECT cut.row_id, doc_id, lang, text, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(text) - len(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals,
         len(text) - len(regexp_replace(text, '[!?]', '', 'g')) AS n_shouts,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (row_id)),
labelled AS (SELECT DISTINCT m.* EXCLUDE (doc_id, row_id), l.quality = 1 AS good FROM measured AS m JOIN labels AS l ON m.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
strata AS (SELECT lang, sum(CASE WHEN good THEN 1 ELSE 0 END)::BIGINT AS n_good FROM labelled GROUP BY lang),
terms AS (
  SELECT lang, n_good, i, n_good * ln(1 - {rate!r}) + i * ln({rate!r} / (1 - {rate!r}))
         + coalesce(sum(ln(greatest(n_good - i + 1, 1) / i::DOUBLE)) FILTER (WHERE i > 0) OVER (PARTITION BY lang ORDER BY i), 0) AS term
  FROM (SELECT lang, n_good, unnest(generate_series(0, CAST(floor(n_good * {rate!r}) AS BIGINT))) AS i FROM strata)),
allowed AS (
  SELECT lang, coalesce(max(i) FILTER (WHERE tail <= {DELTA!r} / ({len(tests)} * (SELECT count(*) FROM strata))), -1) AS allowed
  FROM (SELECT lang, i, sum(exp(term)) OVER (PARTITION BY lang ORDER BY i) AS tail FROM terms) GROUP BY lang),
counted AS ({counted}),
chosen AS (
  SELECT lang, rule, cutoff FROM counted JOIN allowed USING (lang) WHERE g <= allowed AND b > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY b DESC, cutoff DESC) = 1),
limits AS (SELECT lang, {limits} FROM chosen GROUP BY lang),
judged AS (
  SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failing}) AS failed_rules
  FROM measured AS m LEFT JOIN limits USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged"""


SQL = _sql()
