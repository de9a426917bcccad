import json

import pytest
from pyspark.sql import functions as F

from loomwright.sources import sites


def files(folder):
    return {p.name: p.read_text(encoding="utf-8") for p in folder.iterdir()} if folder.exists() else {}


def pages(spark, rows, parts=3):
    return spark.createDataFrame(rows, "slug string, html string").repartition(parts)


def test_pages_are_files_and_a_new_build_replaces_them(spark, tmp_path):
    site = tmp_path / "pages"
    rows = [(f"page-{i}", f"<p>é {i}\n</p>") for i in range(40)] + [("empty", None)]
    sites.write_pages(pages(spark, rows), f"file://{site}")
    assert files(site) == {f"{s}.html": h or "" for s, h in rows}
    (site / "keep.txt").write_text("no page")
    sites.write_pages(pages(spark, rows[:3], 1), f"file://{site}")
    assert files(site) == {f"{s}.html": h for s, h in rows[:3]} | {"keep.txt": "no page"}
    sites.write_pages(pages(spark, [], 1), f"file://{site}")
    assert files(site) == {"keep.txt": "no page"}


@pytest.mark.parametrize("bad", [("page-1", "twice"), ("a/b", "x"), (None, "x"), ("_hidden", "x")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    site = tmp_path / "pages"
    sites.write_pages(pages(spark, [("old", "stays")]), f"file://{site}")
    with pytest.raises(Exception):
        sites.write_pages(pages(spark, [(f"page-{i}", "x") for i in range(20)] + [bad], 4), f"file://{site}")
    assert files(site) == {"old.html": "stays"}


@pytest.mark.parametrize("n", [0, 1, 2, 200])
def test_ordered_files_equal_a_plain_dump(spark, tmp_path, n):
    rows = [(f"s{i:03d}", f"Títle {i} \"q\" \\ 😀\n", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "slug string, title string, size int").repartition(7)
    size = sites.write_search_script(docs, f"file://{tmp_path}/search.js")
    want = "window.WIKI_SEARCH_INDEX = " + json.dumps([{"slug": s, "title": t, "size": i} for s, t, i in rows], ensure_ascii=False, separators=(",", ":")) + ";\n"
    got = (tmp_path / "search.js").read_bytes()
    assert got.decode() == want and len(got) == size
    maps = docs.select(F.when(F.col("size") % 3 == 0, "b one").otherwise("b2").alias("book"), F.col("size").alias("page"), "slug", "title", F.create_map(F.lit("k"), F.lit("v")).alias("sections"))
    sites.write_previews_script(docs, maps, f"file://{tmp_path}/previews.js")
    told = {s: {"title": t, "size": i} for s, t, i in rows}
    book = {b: {str(i): {"slug": s, "title": t, "sections": {"k": "v"}} for s, t, i in rows if (i % 3 == 0) == (b == "b one")} for b in ("b one", "b2")}
    want = "".join(f"window.{k} = {json.dumps(v, ensure_ascii=False, indent=2)};\n" for k, v in (("WIKI_PREVIEWS", told), ("WIKI_PAGE_MAP", {b: x for b, x in book.items() if x})))
    assert (tmp_path / "previews.js").read_text(encoding="utf-8") == want
    assert {p.name for p in tmp_path.iterdir()} == {"search.js", "previews.js"}


def test_file_systems_that_only_append_get_the_same_bytes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"s{i:03d}", i) for i in range(50)], "slug string, size int").repartition(5)
    sites.write_search_script(docs, f"file://{tmp_path}/a.js")
    monkeypatch.setattr(sites.fs, "LocalFileSystem", type(None))
    sites.write_search_script(docs, f"file://{tmp_path}/b.js")
    assert (tmp_path / "a.js").read_bytes() == (tmp_path / "b.js").read_bytes()
