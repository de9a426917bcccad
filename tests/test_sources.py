import pytest
from pyspark.sql import functions as F

from loomwright import __main__ as cli
from loomwright import build as wiki
from loomwright.operators import search
from loomwright.sources import pdf, sites, tables


def test_index_of_a_folder(spark, tmp_path):
    rows = [(1, "u", "<title>A</title><p>one</p>"), (2, "v", "<title>B</title><p>two</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    given = cli.arguments(["-i", str(tmp_path)])
    assert given.output == str(tmp_path / "index")
    assert cli.build(spark, given.input, given.output) == 2
    assert {r.title for r in spark.read.json(f"{given.output}/search_index").collect()} == {"A", "B"}


def test_spans_of_nested_pages(spark):
    page = (1, [(0, [([(1.0, 2.0, 3.0, "a\tb", "F", 9.0), (1.0, 2.0, 3.0, "  ", "F", 9.0)],)]), (1, [])])
    schema = "page int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<x:double,y:double,x1:double,text:string,font:string,size:double>>>>>>"
    assert [(r.page, r.text) for r in tables.spans(spark.createDataFrame([page], schema)).collect()] == [(1, "a b")]


def test_map_labels_and_contents(spark):
    df = spark.createDataFrame([("Map 1 - Green Vale - 11 x 14.jpg",)], "n string")
    assert df.select(tables.map_label(F.col("n")).alias("l")).first().l == "Map 1 — Green Vale"
    assert tables.toc(spark.createDataFrame([(" a ", 0), (" b ", 1)], "title string, page int")).collect()[0].title == "b"


def test_scripts_and_loading(spark, tmp_path):
    df = spark.createDataFrame([("a", "é", {"s": "x"})], "slug string, title string, sections map<string,string>")
    maps = spark.createDataFrame([("book2", 4, "a", "é", {"mill": "m"})], "book string, page int, slug string, title string, sections map<string,string>")
    sites.write_previews_script(df, maps, str(tmp_path / "previews-data.js"))
    script = (tmp_path / "previews-data.js").read_text(encoding="utf-8")
    assert script.startswith('window.WIKI_PREVIEWS = {\n  "a"') and "é" in script
    got = tables.read_script(str(tmp_path / "previews-data.js"))
    assert got["WIKI_PAGE_MAP"] == {"book2": {"4": {"slug": "a", "title": "é", "sections": {"mill": "m"}}}}
    docs = spark.createDataFrame([("b", "T", "t"), ("a", "U", "u")], "slug string, title string, text string")
    sites.write_search_script(docs, str(tmp_path / "search-index.js"))
    loaded = tables.Loaded(spark)
    args = (str(tmp_path), "search_docs", "slug string, title string, text string", "search-index.js", "WIKI_SEARCH_INDEX")
    first = loaded.get(*args)
    assert [r.slug for r in first.collect()] == ["a", "b"] and loaded.get(*args) is first
    assert loaded.get(str(tmp_path), "nothing", "slug string").count() == 0 and tables.read_script("/no/such") == {}


def test_counted_rows(spark):
    df, seen = tables.counted(spark.range(7), "rows")
    assert df.where("id > 3").count() == 3 and seen.get["n"] == 7


def test_output_and_static_files(tmp_path):
    (tmp_path / "static" / "css").mkdir(parents=True)
    (tmp_path / "static" / "css" / "wiki.css").write_text("x")
    out = tmp_path / "wiki"
    (tmp_path / "old" / "pages").mkdir(parents=True)
    (tmp_path / "old" / "pages" / "gone.html").write_text("x")
    tables.reset_output(str(out), str(tmp_path / "old"))
    assert not (tmp_path / "old").exists() and list((out / "pages").iterdir()) == []
    assert tables.copy_static(str(tmp_path / "static"), str(out)) == 1 and (out / "css" / "wiki.css").read_text() == "x"
    with pytest.raises(FileNotFoundError):
        tables.copy_static(str(tmp_path / "none"), str(out))


def test_map_files_of_a_folder(spark, tmp_path):
    for name in ("Maps/Map 1.jpg", "Maps/old/Map 1.jpg", "maps/map 1.jpg", "maps/Map 2.png", "Maps/Plan.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted((r.name, r.folder, r.path) for r in tables.map_files(spark, str(tmp_path)).collect()) == [("map 1.jpg", 0, "Map 1.jpg"), ("map 2.png", 1, "Map 2.png")]
    assert tables.map_files(spark, str(tmp_path / "none")).count() == 0


def book_tables(spark, folder):
    toc = [(1, 1, "Contents", 1), (2, 1, "The Town", 2), (3, 1, "The Mill", 3)]
    spark.createDataFrame(toc, "ord int, level int, title string, page int").write.parquet(f"{folder}/toc.parquet")
    spark.createDataFrame([(i, 396.0, 612.0) for i in (1, 2, 3)], "page int, width double, height double").write.parquet(f"{folder}/book_pages.parquet")
    spans = [
        (2, 1, 30.0, 20.0, 70.0, "The Town", "Body", 9.0), (2, 2, 30.0, 100.0, 90.0, "Old Wolves", "Avara", 12.0), (2, 3, 30.0, 120.0, 180.0, "They live there, by the old", "Body", 9.0), (2, 4, 30.0, 132.0, 180.0, "Stone Gate (page 3). Roll 1d6.", "Body", 9.0),
        (3, 1, 30.0, 100.0, 90.0, "Stone Gate", "Avara", 12.0), (3, 2, 30.0, 120.0, 180.0, "Here the Old Wolves (page 2) sleep", "Body", 9.0), (3, 3, 30.0, 132.0, 180.0, "for all of the long winter nights.", "Body", 9.0),
    ]
    spark.createDataFrame(spans, "page int, ord long, x double, y double, x1 double, text string, font string, size double").write.parquet(f"{folder}/spans.parquet")
    spark.createDataFrame([], "page int, ord long, kind string, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{folder}/shapes.parquet")
    spark.createDataFrame([], "page int, ord long, x0 double, y0 double, x1 double, y1 double, name string").write.parquet(f"{folder}/icons.parquet")


def test_wiki_of_a_book(spark, tmp_path):
    book_tables(spark, str(tmp_path))
    book = cli.read_book(spark, str(tmp_path))
    done = wiki.build(book, str(tmp_path / "work"))
    out = tmp_path / "wiki"
    (tmp_path / "static").mkdir()
    (tmp_path / "static" / "wiki.css").write_text("x")
    told = wiki.write(done, str(out), str(tmp_path / "static"))
    assert told["pages"] == 2 and told["sections"] == 2 and told["static"] == 1
    town, mill = (out / "pages" / "the-town.html").read_text(), (out / "pages" / "the-mill.html").read_text()
    assert '<h2 id="old-wolves">Old Wolves</h2>' in town and '<a class="wiki-link" href="the-mill.html#stone-gate" data-slug="the-mill" data-fragment="stone-gate">by the old Stone Gate</a>. Roll <button' in town
    assert '<a class="wiki-link" href="the-town.html#old-wolves" data-slug="the-town" data-fragment="old-wolves">Here the Old Wolves</a> sleep for all of the long winter nights.' in mill
    assert '<a href="the-mill.html">The Mill</a><ul class="nav-sections">' in town
    held = tables.read_script(str(out / "js" / "previews-data.js"))
    assert held["WIKI_PREVIEWS"]["the-mill"]["sections"]["stone-gate"]["name"] == "Stone Gate" and held["WIKI_PAGE_MAP"]["book2"]["2"]["slug"] == "the-town"
    found = search.search(done.search, "old wolves").collect()
    assert [(r.slug, r.where) for r in found] == [("the-mill", "text"), ("the-town", "text")]
    assert "The Mill" in (out / "index.html").read_text()
    assert cli.read_book(spark, str(tmp_path / "static")) is None


def test_pdf_source_without_its_library(spark):
    pytest.importorskip("pyspark.sql.datasource")
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="PyMuPDF"):
            pdf.PdfReader({"path": "x.pdf"}).partitions()
