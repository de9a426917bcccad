"""Sources: tables of a data folder, HTML pages, layout JSON, scripts; the output folder. Pages and scripts are written by sites."""

from __future__ import annotations

import json
import re
import shutil
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toc(rows: DataFrame) -> DataFrame:
    """Entries on a page, with their titles trimmed."""
    return rows.where("page >= 1").withColumn("title", F.trim("title"))


def spans(pages: DataFrame, top: float = 0.0, bottom: float = 1e9) -> DataFrame:
    """(page, ord, x, y, x1, text, font, size) from pages with nested blocks, lines and spans; text blocks alone, blanks dropped."""
    b = pages.select("page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    s = b.select("page", "b", F.posexplode("block.lines").alias("l", "line")).select("page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    text = F.replace("span.text", F.lit("\t"), F.lit(" "))
    df = s.select("page", (F.col("b") * 1_000_000 + F.col("l") * 1000 + F.col("s")).cast("long").alias("ord"), F.col("span.x").alias("x"), F.col("span.y").alias("y"), F.col("span.x1").alias("x1"), text.alias("text"), F.col("span.font").alias("font"), F.col("span.size").alias("size"))
    inside = df.where((F.trim("text") != "") & (F.col("y") >= top) & (F.col("y") < bottom))
    # Headers are sometimes printed twice at one place: the first stays.
    once = inside.groupBy("page", F.bround("x").alias("x_"), F.bround("y").alias("y_"), F.trim("text").alias("t_")).agg(F.min_by(F.struct(*inside.columns), "ord").alias("row"))
    return once.select("row.*")


#: Image files of maps, in the order in which equal names are told apart.
MAP_KINDS = ("jpg", "jpeg", "png")


def map_order(path: Column, folder: Column) -> Column:
    """Where a file stands among equal names: by folder, files at its top before nested ones, by kind, then by path. Null if it is no map."""
    name = F.substring_index(path, "/", -1)
    kind = F.array_position(F.array(*[F.lit(k) for k in MAP_KINDS]), F.regexp_extract(name, r"\.([a-z]+)$", 1))
    nested = F.contains(path, F.lit("/")).cast("int")
    return F.when(name.rlike(r"^Map .*\.(jpg|jpeg|png)$"), F.struct(folder.alias("folder"), nested.alias("nested"), kind.alias("kind"), path.alias("path")))


def first_of_name(files: DataFrame) -> DataFrame:
    """Of map files of equal names (ignoring case) the first; files: (folder, path), path within the folder, folders in their order."""
    o = map_order(F.col("path"), F.col("folder"))
    found = files.withColumn("o", o).where("o is not null").withColumn("name", F.lower(F.substring_index("path", "/", -1)))
    return found.groupBy("name").agg(F.min("o").alias("o")).select("name", "o.folder", "o.path")


def map_files(spark: SparkSession, folder: str) -> DataFrame:
    """Map images under the folders Maps and maps of an input folder; none if there are no such folders."""
    found = None
    for n, base in enumerate(("Maps", "maps")):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Map *").load(f"{folder}/{base}").select("path")
        except AnalysisException:  # there is no such folder
            continue
        mine = files.select(F.lit(n).alias("folder"), F.substring_index("path", f"/{base}/", -1).alias("path"))
        found = mine if found is None else found.unionByName(mine)
    return first_of_name(found if found is not None else spark.createDataFrame([], "folder int, path string"))


def is_shown_map(name: Column) -> Column:
    """The large sheets, but for those that the book's own spreads show."""
    stem = F.lower(F.regexp_replace(name, r"\.[A-Za-z]+$", ""))
    return F.contains(stem, F.lit("11 x 14")) & ~F.contains(stem, F.lit("vicinity")) & ~F.contains(stem, F.lit("world"))


def map_label(name: Column) -> Column:
    """A map's label from its file name: no extension and no paper size, a dash after the number."""
    base = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    for size in (r"11\s*x\s*14", "A4", r"8\.?5\s*x\s*11"):
        base = F.regexp_replace(base, rf"(?i)\s*-\s*{size}\s*$", "")
    head, cut = F.regexp_extract(base, r"^(.*?)\s*-\s*(.*)$", 1), F.regexp_extract(base, r"^(.*?)\s*-\s*(.*)$", 2)
    return F.when(base.rlike(r"^.*?\s*-\s*.*$"), F.concat(head, F.lit(" — "), cut)).otherwise(base)


def reset_output(folder: str, legacy: str | None = None) -> None:
    """An output folder without the pages of an earlier build; a folder of an older name is renamed to it."""
    out = Path(folder)
    if legacy and Path(legacy).is_dir() and not out.exists():
        Path(legacy).rename(out)
    for name in ("pages", "images/icons"):
        shutil.rmtree(out / name, ignore_errors=True)
        (out / name).mkdir(parents=True, exist_ok=True)
    (out / "js").mkdir(parents=True, exist_ok=True)


def copy_static(source: str, folder: str) -> int:
    """All files under a folder of static assets, in order; how many. It is an error if there are none."""
    files = sorted(p for p in Path(source).rglob("*") if p.is_file()) if Path(source).is_dir() else []
    if not files:
        raise FileNotFoundError(f"no static assets in {source}")
    for p in files:
        to = Path(folder) / p.relative_to(source)
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(p, to)
    return len(files)


def write_search_index(docs: DataFrame, folder: str) -> None:
    """The search documents as JSON lines, in parts."""
    docs.write.mode("overwrite").json(folder)


def read_script(path: str) -> dict[str, object]:
    """The globals of a script file; none if it can't be read."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError:
        return {}
    out: dict[str, object] = {}
    decoder = json.JSONDecoder()
    for name, at in ((m[1], m.end()) for m in re.finditer(r"(?m)^window\.(\w+) = ", text)):
        try:
            out[name] = decoder.raw_decode(text, at)[0]
        except ValueError:
            continue
    return out


class Loaded:
    """Tables that are read once and kept: from Parquet, else from a script's global, else empty."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def get(self, folder: str, name: str, schema: str, script: str | None = None, value: str | None = None) -> DataFrame:
        key = f"{folder}/{name}"
        if key not in self.held:
            try:
                df = self.spark.read.parquet(key)
            except AnalysisException:
                given = read_script(f"{folder}/{script}").get(value, []) if script else []
                wanted = StructType.fromDDL(schema)
                df = self.spark.createDataFrame([{n: r.get(n) for n in wanted.names} for r in given], wanted)
            self.held[key] = df.cache()
        return self.held[key]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows as they are, and the number of them once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def page_documents(pages: DataFrame) -> DataFrame:
    """(page_id, title, html) of raw web pages."""
    return pages.select("page_id", T.title_of("html").alias("title"), "html")
