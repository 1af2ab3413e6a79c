"""Preference formatting: the turns that a chosen and a rejected conversation share, once, and both completions, masked.

The prompt is the longest common prefix of turns: all turns before the first one at which the two differ in role or
text, or that one of them lacks. It is rendered once; what follows is rendered for either side. Only assistant turns of
a completion are trained on: their text and end mark, given as a span of characters of the completion.

The result has a row per rendered turn, so a conversation that holds a third of all turns is split like any other:
where sides part is a minimum combined before the shuffle, and places within a part are summed in slices of
``SLICE`` turns whose totals alone are ordered together. ``assembled`` joins the rows of pairs that fit in memory.

A pair needs turns on both sides. Turns are ordered by their number; of rows that repeat a number, role and text one
counts, and rows that share a number only are ordered by role and text. Null roles and texts count as empty; rows with a
null pair or turn number are passed over. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagweave.operators.ordering import rank_by_range

SLICE = 1024


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of every pair.

    Both tables have pair_id, turn, role and text. Returns pair_id, part (prompt, chosen or rejected), turn, place
    (among rows of the same number, from 1), role, rendered, start (of the turn in its part, in characters), and
    loss_start and loss_end (span in the part that is trained on, else null).
    """
    sides = _side(chosen, 0).unionByName(_side(rejected, 1))
    at = F.struct("turn", "place")
    # A turn that both sides have the same is there twice with equal content.
    met = (sides.groupBy("pair_id", "turn", "place")
           .agg(F.count("*").alias("sides"), F.min(F.struct("role", "text")).alias("low"),
                F.max(F.struct("role", "text")).alias("high")))
    parting = (met.filter("sides < 2 OR low <> high").groupBy("pair_id").agg(F.min(at).alias("parting")))
    both = sides.groupBy("pair_id").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a <> b")
    rows = (sides.join(both.select("pair_id"), "pair_id", "left_semi").join(parting, "pair_id", "left")
            .withColumn("shared", F.coalesce(at < F.col("parting"), F.lit(True)))
            .filter("NOT shared OR side = 0")
            .withColumn("part", F.when(F.col("shared"), "prompt").when(F.col("side") == 0, "chosen")
                        .otherwise("rejected")))
    head = F.concat(F.lit("<|"), "role", F.lit("|>\n"))
    rendered = rows.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit("<|end|>\n")))
    placed = _starts(rendered)
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    end = F.col("start") + F.length("rendered")
    return placed.select(
        "pair_id", "part", "turn", "place", "role", "rendered", "start",
        F.when(trained, F.col("start") + F.col("head")).alias("loss_start"), F.when(trained, end).alias("loss_end"))


def _side(turns: DataFrame, side: int) -> DataFrame:
    """Distinct turns of one side, rows of the same number told apart by ``place``."""
    rows = (turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
            .select("pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")).distinct())
    same = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    return rows.withColumn("place", F.row_number().over(same)).withColumn("side", F.lit(side))


def _starts(rows: DataFrame) -> DataFrame:
    """Characters of the part before each turn, in two levels: within slices of turns, and before each slice."""
    sliced = rows.withColumn("slice", F.floor(F.col("turn") / SLICE)).withColumn("size", F.length("rendered"))
    before = Window.partitionBy("pair_id", "part").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = (Window.partitionBy("pair_id", "part", "slice").orderBy("turn", "place")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = (sliced.groupBy("pair_id", "part", "slice").agg(F.sum("size").alias("total"))
              .withColumn("earlier", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total"))
    return (sliced.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(totals, ["pair_id", "part", "slice"])
            .withColumn("start", (F.col("within") + F.col("earlier")).cast("bigint")))


def assembled(rows: DataFrame) -> DataFrame:
    """A row per pair: prompt, chosen and rejected texts and the spans (start, end) of either that are trained on.

    For conversations that fit in a row; :func:`segments` has no such bound.
    """
    def text(part: str):
        kept = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("start", "rendered"))))
        return F.array_join(F.transform(kept, lambda s: s.rendered), "")

    def spans(part: str):
        kept = (F.col("part") == part) & F.col("loss_start").isNotNull()
        return F.sort_array(F.collect_list(F.when(kept, F.struct("loss_start", "loss_end"))))

    return rows.groupBy("pair_id").agg(
        text("prompt").alias("prompt"), text("chosen").alias("chosen"), spans("chosen").alias("chosen_spans"),
        text("rejected").alias("rejected"), spans("rejected").alias("rejected_spans"))


def other_endings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made from plain conversations: each against itself with the last assistant turn of the next one by id.

    Each conversation with an assistant turn is a pair; the next one is the next that has such a turn, and the first for the
    last. It is the chosen side; the rejected side has its last assistant turn's text taken from the other's.
    """
    rows = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (rows.filter(F.col("role") == "assistant").groupBy("pair_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")))
    last = rank_by_range(last, [], ["pair_id"], "place")
    before = F.col("place") - 1
    others = last.select(F.when(before == 0, F.lit(last.agg(F.max("place")).first()[0])).otherwise(before).alias("place"),
                         F.col("last.text").alias("other"))
    ends = last.select("pair_id", "place", F.col("last.turn").alias("last_turn")).join(others, "place").drop("place")
    paired = rows.join(ends, "pair_id")
    replaced = (F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant")
    return (paired.select("pair_id", "turn", "role", "text"),
            paired.select("pair_id", "turn", "role",
                          F.when(replaced, F.col("other")).otherwise(F.col("text")).alias("text")))
