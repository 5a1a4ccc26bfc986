"""Preference examples from pairs of conversations.

The longest common turn prefix of the chosen and the rejected conversation is rendered once, as the prompt; what remains of
each is its completion, with a mask of one digit for each code point: 1 where the text of an assistant and the mark of its
end are to be learned, 0 elsewhere. All built-in expressions; a turn is a struct of role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bartide.llm.common import stored

TRAINED = "assistant"


def _role(turn: Column) -> Column:
    return F.coalesce(F.lower(F.trim(turn["role"])), F.lit("unknown"))


def _plain(text: Column) -> Column:
    """Marks inside a text are broken up, so that only the format opens and closes turns."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(_role(turn)), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    learned = lambda t: F.when(_role(t) == TRAINED, "1").otherwise("0")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.repeat(F.lit("0"), F.length(_head(t))), F.repeat(learned(t), F.length(_body(t))))), "")


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """Turns of the longest common prefix, less those without which a completion would be empty."""
    least = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, least), F.slice(rejected, 1, least), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, False)
    return F.greatest(F.least(F.when(differs == 0, least).otherwise(differs - 1), least - 1), F.lit(0)).cast("int")


def preference_examples(pairs: DataFrame) -> DataFrame:
    """The columns of `pairs` but chosen and rejected (arrays of turns), then n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask.

    A null or empty conversation has an empty completion and an empty mask; a null role is 'unknown', a null text empty.
    Conversations of which one continues the other share all but the last turn of the shorter one."""
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    sides = pairs.withColumns({c: F.coalesce(F.col(c), empty) for c in ("chosen", "rejected")}).withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    others = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    rest = {c: F.slice(F.col(c), F.col("n_shared") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("chosen", "rejected")}
    return sides.select(*others, "n_shared", rendered(F.slice("chosen", F.lit(1), F.col("n_shared"))).alias("prompt"), rendered(rest["chosen"]).alias("chosen"), mask(rest["chosen"]).alias("chosen_mask"),
                        rendered(rest["rejected"]).alias("rejected"), mask(rest["rejected"]).alias("rejected_mask"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (ordered), opening and whole (digests of the first turn and of all). Rows with a null conv_id take no part;
    repeated rows count once; equal turn numbers are ordered by role and text, null numbers come first."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                                                             F.col("text").cast("string").alias("text")).alias("t")).where("conv_id is not null")
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.collect_list("t"))).alias("ordered"))
    lists = lists.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    part = lambda t: F.concat(F.coalesce(t["role"], F.lit("\x01")), F.lit("\x02"), F.coalesce(t["text"], F.lit("\x01")))
    return lists.select("conv_id", "turns", F.md5(part(F.col("turns")[0])).alias("opening"), F.md5(F.array_join(F.transform("turns", part), "\x03")).alias("whole"))


def sibling_pairs(conversations: DataFrame) -> DataFrame:
    """(a, b): of the different conversations that open with one turn, each with the next one by conv_id. Copies of a
    conversation count once, under their smallest conv_id. Conversations are dealt by range of (opening, conv_id), so a common opening is never
    ordered by one task, however its ids are spread; the ends of the ranges, one a partition, are ordered by range."""
    once = conversations.groupBy("opening", "whole").agg(F.min("conv_id").alias("a"))
    once = stored(once.select("opening", "a").repartitionByRange("opening", "a").withColumn("bucket", F.spark_partition_id()))
    inside = once.withColumn("next", F.lead("a").over(Window.partitionBy("opening", "bucket").orderBy("a")))
    starts = once.groupBy("opening", "bucket").agg(F.min("a").alias("start"))
    starts = starts.select("opening", "bucket", F.lead("start").over(Window.partitionBy("opening").orderBy("bucket")).alias("after"))
    joined = inside.join(starts, ["opening", "bucket"])
    return joined.select("a", F.coalesce("next", "after").alias("b")).where("b is not null")


def pairs_of(turns: DataFrame) -> DataFrame:
    """kind, conv_id, other_id, chosen, rejected from plain conversations, which carry no preference of their own.

    sibling: two different conversations with one opening turn; chosen is the one of more turns, or of the smaller id.
    stale: a conversation with several assistant turns against itself with the last reply replaced by its first one, where
    these differ."""
    conversations = stored(conversations_of(turns))
    pairs = sibling_pairs(conversations)
    for side in ("a", "b"):
        pairs = pairs.join(conversations.select(F.col("conv_id").alias(side), F.col("turns").alias(f"turns_{side}")), side)
    first = F.size("turns_a") >= F.size("turns_b")
    both = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    siblings = pairs.select(F.lit("sibling").alias("kind"), both("a", "b").alias("conv_id"), both("b", "a").alias("other_id"), both("turns_a", "turns_b").alias("chosen"), both("turns_b", "turns_a").alias("rejected"))
    replies = conversations.withColumn("places", F.filter(F.transform("turns", lambda t, i: F.when(_role(t) == TRAINED, i + 1)), lambda i: i.isNotNull())).where(F.size("places") > 1)
    replies = replies.withColumn("first", F.element_at("turns", F.element_at("places", 1))).withColumn("last", F.element_at("places", -1))
    stale = replies.where(~F.element_at("turns", F.col("last"))["text"].eqNullSafe(F.col("first")["text"])).select(
        F.lit("stale").alias("kind"), "conv_id", F.col("conv_id").alias("other_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array("first"), F.slice("turns", F.col("last") + 1, F.size("turns"))).alias("rejected"))
    return siblings.unionByName(stale)


def chat_preferences(turns: DataFrame) -> DataFrame:
    return preference_examples(pairs_of(turns))


def _sql() -> str:
    role = "coalesce(lower(trim(t.role)), 'unknown')"
    head = f"'<|' || replace({role}, '<|', '< |') || '|>' || chr(10)"
    body = "replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)"
    render = lambda x: f"array_to_string(list_transform({x}, lambda t: {head} || {body}), '')"
    masked = lambda x: f"array_to_string(list_transform({x}, lambda t: repeat('0', len({head})) || repeat(CASE WHEN {role} = '{TRAINED}' THEN '1' ELSE '0' END, len({body}))), '')"
    return f"""
WITH convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
once AS (SELECT min(conv_id) AS a, turns, turns[1] AS opening FROM convs GROUP BY turns),
near AS (SELECT a, lead(a) OVER (PARTITION BY opening ORDER BY a) AS b FROM once),
doubled AS (SELECT a, b, x.turns AS ta, y.turns AS tb FROM near JOIN convs AS x ON x.conv_id = a JOIN convs AS y ON y.conv_id = b),
places AS (
  SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: coalesce(lower(trim(turns[i].role)), 'unknown') = '{TRAINED}') AS p FROM convs),
pairs AS (
  SELECT 'sibling' AS kind, CASE WHEN len(ta) >= len(tb) THEN a ELSE b END AS conv_id, CASE WHEN len(ta) >= len(tb) THEN b ELSE a END AS other_id,
         CASE WHEN len(ta) >= len(tb) THEN ta ELSE tb END AS c, CASE WHEN len(ta) >= len(tb) THEN tb ELSE ta END AS r FROM doubled
  UNION ALL
  SELECT 'stale', conv_id, conv_id, turns, turns[:p[-1] - 1] || [turns[p[1]]] || turns[p[-1] + 1:] FROM places
  WHERE len(p) > 1 AND turns[p[-1]].text IS DISTINCT FROM turns[p[1]].text),
shared AS (
  SELECT *, greatest(least(coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))),
                           least(len(c), len(r)) - 1), 0) AS n FROM pairs)
SELECT kind, conv_id, other_id, CAST(n AS INTEGER) AS n_shared, {render('c[:n]')} AS prompt, {render('c[n + 1:]')} AS chosen, {masked('c[n + 1:]')} AS chosen_mask,
       {render('r[n + 1:]')} AS rejected, {masked('r[n + 1:]')} AS rejected_mask FROM shared"""


SQL = _sql()
