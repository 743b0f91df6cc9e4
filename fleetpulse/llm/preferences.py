"""Preference formatting: the turns that chosen and rejected conversations share become one prompt, the rest completions.

Results have one row per turn, so a conversation of any length is spread like other rows. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """A turn in the chat template, and how many characters come before its text."""
    head = F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))
    return F.concat(head, F.coalesce(text, F.lit("")), F.lit("<|end|>\n")), F.length(head)


def common_prefix(turns: DataFrame) -> DataFrame:
    """(_pair, _first): the first turn at which the two sides of (_pair, _at, _side, role, text) differ, null if none does."""
    content = F.xxhash64("role", "text").cast("decimal(38,0)")  # sums of many hashes stay exact
    sums = [F.sum(F.when(F.col("_side") == side, content)).alias(f"h{side}") for side in (0, 1)]
    sizes = [F.count(F.when(F.col("_side") == side, 1)).alias(f"n{side}") for side in (0, 1)]
    by_turn = turns.groupBy("_pair", "_at").agg(*sums, *sizes)
    differs = ~(F.col("h0").eqNullSafe(F.col("h1")) & (F.col("n0") == F.col("n1")))
    return by_turn.groupBy("_pair").agg(F.min(F.when(differs, F.col("_at"))).alias("_first"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Prompt once, then both completions, for each pair of conversations given as (pair_id, turn, role, text).

    Returns pair_id, part (prompt, chosen, rejected), turn, role, rendered, loss_start and loss_end. A turn of a completion is
    trained on from loss_start to loss_end (code points of `rendered`) if its role is assistant; everything else is masked
    and has 0 and 0. Turns are alike if role and text are; several rows of one turn are compared as a set with counts. A pair
    without differences is all prompt; with only one side, all of it is a completion. A null turn comes last; null roles render
    as unknown and null texts as empty, though a null differs from an empty text; other columns are left out.
    """
    sides = []
    for side, df in enumerate((chosen, rejected)):
        columns = [F.col("pair_id").alias("_pair"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role")]
        columns += [F.col("text").cast("string").alias("text"), F.lit(side).alias("_side"), F.coalesce("turn", F.lit(LAST)).cast("long").alias("_at")]
        sides.append(df.select(*columns))
    turns = sides[0].unionByName(sides[1])
    first = common_prefix(turns).withColumnRenamed("_pair", "_of")
    both = turns.join(first, F.col("_pair").eqNullSafe(F.col("_of")))
    shared = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    kept = both.where(~shared | (F.col("_side") == 0))
    part = F.when(shared, "prompt").when(F.col("_side") == 0, "chosen").otherwise("rejected")
    rendered, head = render(F.col("role"), F.col("text"))
    trained = ~shared & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return kept.select(
        F.col("_pair").alias("pair_id"),
        part.alias("part"),
        "turn",
        "role",
        rendered.alias("rendered"),
        F.when(trained, head).otherwise(0).alias("loss_start"),
        F.when(trained, F.length(rendered) - 1).otherwise(0).alias("loss_end"),
    )
