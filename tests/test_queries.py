import os

import pytest
from compare import rows_match

from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    rows_match(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["slug", "title", "rank", "where", "snippet"]


def test_import_of_package_does_not_need_corpus_operators():
    import ast
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "loomwright"
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(".llm" in n for n in names), path


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_engine_stands_without_corpus_operators(tmp_path, pipeline_too):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_spans_are_not_put_together_in_a_few_partitions(spark):
    from pyspark.sql import functions as F

    parts = catalog.QUERIES["spans_of_pages"](spark, SF).select(F.spark_partition_id().alias("n")).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_search_array_has_whole_texts(spark, tmp_path):
    """Nothing is cut at the size of the search index, and what is searched for at a text's end is there."""
    long = "<html><title>Long</title><p>" + "word and " * 20_000 + "the last words</p></html>"
    rows = [(i, f"u{i}", html) for i, html in enumerate([long, "<title>Short</title><p>a few words</p>", "<title>Éé</title><p>" + "é\"\\ " * 50_000 + "end</p>"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows_match(spark, catalog.QUERIES["search_array"], catalog.ORACLE_SQL["search_array"], str(tmp_path))
    got = {r.slug: r.text for r in catalog.QUERIES["search_array"](spark, str(tmp_path)).collect()}
    assert got[0].endswith("the last words") and len(got[0]) == len("Long Long " + "word and " * 20_000 + "the last words")
    assert got[2].endswith("end") and len(got[2]) > 150_000
