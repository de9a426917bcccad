"""Positioned text to reading-order lines. spans: (page, ord, x, y, x1, text, font, size)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from loomwright.operators import wrap as W


def dedupe_rounded(df: DataFrame, key: list[str], coords: list[str], same: list[str], order: str) -> DataFrame:
    """Of rows whose coordinates round (half to even) alike, the first."""
    rounded = [F.bround(F.col(c), 0) for c in coords]
    w = Window.partitionBy(*key, *rounded, *same).orderBy(order)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def bucket_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, line): words grouped by half points of y, joined in the order of x."""
    y = F.bround(F.col("y") * 2, 0) / 2
    g = words.groupBy(*key, y.alias("line_y")).agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("w"))
    return g.select(*key, "line_y", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"))


def assign_columns(df: DataFrame, gutter: Column) -> DataFrame:
    return df.withColumn("col", F.when(F.col("x") < gutter, 0).otherwise(1))


def cluster_lines(spans: DataFrame, key: list[str], within: float = 4.5) -> DataFrame:
    """(key, ord, line_y): a span joins the line whose first y is at most `within` away, else begins one. Anchored at the first span,
    so a gap rule does not do: spans stream by in order and the line's first y is all that is kept."""
    rows = spans.select(*key, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("ord").cast("long").alias("ord"))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "y", "x", "ord")
    schema = S.StructType([*[rows.schema[k] for k in key], S.StructField("ord", S.LongType()), S.StructField("line_y", S.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, first = None, None
        for batch in batches:
            line_y = []
            for *mine, y in zip(*[batch.column(k).to_pylist() for k in key], batch.column("y").to_pylist(), strict=True):
                if first is None or mine != page or abs(y - first) > within:
                    page, first = mine, y
                line_y.append(first)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], batch.column("ord"), pa.array(line_y, pa.float64())], names=[*key, "ord", "line_y"])

    return ordered.mapInArrow(run, schema)


def glyphs_of_lines(lines: DataFrame, glyphs: DataFrame, key: list[str], band: float, left: float) -> DataFrame:
    """Lines with the first glyph whose centre is within `band` of theirs and at most `left` before their first x."""
    g = glyphs.select(*[F.col(k).alias(f"g_{k}") for k in key], F.col("ord").alias("g_ord"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    on = [F.col(k) == F.col(f"g_{k}") for k in key] + [F.abs(F.col("y") - F.col("gy")) <= band, F.col("gx") < F.col("x"), F.col("x") - F.col("gx") <= left]
    return lines.join(g, on, "left").groupBy(*key, "ord").agg(F.min("g_ord").alias("glyph"))


def assemble(spans: DataFrame, key: list[str], gap: float = 1.0) -> DataFrame:
    """(key, line): spans joined in the order of x, a space where the gap is over `gap`, none before closing signs."""
    w = Window.partitionBy(*key).orderBy("x", "ord")
    piece = F.when(F.col("x") - F.lag("x1").over(w) > gap, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    df = spans.withColumn("piece", piece)
    g = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("x", "ord", "piece"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return g.select(*key, F.trim(F.regexp_replace(F.regexp_replace(joined, r" +([,.;:!?)])", "$1"), " +", " ")).alias("line"))


def rules_apart(rules: DataFrame, key: list[str], within: float = 5.0) -> DataFrame:
    """Horizontal rules, without those near any rule of the page that stayed before."""

    def step(kept: list[float], row: dict) -> list[dict]:
        if any(abs(row["y"] - y) <= within for y in kept):
            return []
        kept.append(row["y"])
        return [row]

    return W.fold(rules, key, lambda row: [], step, lambda kept: [], rules.schema, ("ord",))


def icons_to_lines(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Greedy one to one: in the order of lines each takes the first icon in reach that is still free; pairs: (key, line, icon)."""

    def step(state: dict, row: dict) -> list[dict]:
        if row["line"] == state["line"] or row["icon"] in state["used"]:
            return []
        state["line"] = row["line"]
        state["used"].add(row["icon"])
        return [row]

    return W.fold(pairs, key, lambda row: {"line": None, "used": set()}, step, lambda state: [], pairs.schema, ("line", "icon"))
