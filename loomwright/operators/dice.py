"""Dice expressions: parsing, statistics, seeded rolls and roll-table lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import text as T


def parse(df: DataFrame, expression: str) -> DataFrame:
    return df.withColumn("d_", T.dice(expression)).withColumns({c: F.col("d_")[c] for c in ("n", "sides", "mod")}).drop("d_")


def statistics(df: DataFrame, expression: str) -> DataFrame:
    out = parse(df, expression)
    return out.withColumns({"least": F.col("n") + F.col("mod"), "most": F.col("n") * F.col("sides") + F.col("mod"), "mean": F.col("n") * (F.col("sides") + 1) / 2 + F.col("mod")})


def totalled(df: DataFrame, expression: str) -> DataFrame:
    """Rolled parts with their total and the text that shows the roll; df: (.., parts, mod)."""
    out = df.withColumn("total", F.aggregate("parts", F.lit(0), lambda a, b: a + b) + F.col("mod"))
    return out.withColumn("shown", R.roll_text(F.col(expression), F.col("parts"), F.col("mod"), F.col("total")))


def roll(df: DataFrame, expression: str, seed: int) -> DataFrame:
    """parts, total and the text that shows them; the same seed gives the same rolls on the same partitioning."""
    out = parse(df, expression).where("n is not null").withColumn("parts", F.transform(F.sequence(F.lit(1), "n"), lambda _: (F.floor(F.rand(seed) * F.col("sides")) + 1).cast("int")))
    return totalled(out, expression)


def look_up(totals: DataFrame, ranges: DataFrame) -> DataFrame:
    """The last row of a table, by pos, whose range holds the total; totals: (roll_id, table_id, total), ranges: (table_id, pos, lo, hi)."""
    hit = totals.join(ranges, "table_id", "left").groupBy("roll_id", "table_id", "total")
    return hit.agg(F.max(F.when(F.col("total").between(F.col("lo"), F.col("hi")), F.col("pos"))).alias("row_pos"))
