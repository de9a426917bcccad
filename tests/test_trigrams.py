import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import search, trigrams

SCHEMA = "slug long, title string, text string, excerpt string"
QUERIES = ["", "  ", "abc", "ABC ab", "a", "b a", "ab", "çé", "x😀y", "😀", "abcab cabc", "zzz", "no such", "% _", "tail", "İx", "only title"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc é") for _ in range(rng.choice((0, 1, 2, 9)))), "".join(rng.choice("abcABÇé 😀xy%_") for _ in range(rng.choice((0, 1, 2, 5, 60)))), "e") for i in range(400)]
    rows += [(1000, None, None, None), (1001, "Only", "TITLE words"), (1002, "Only Title", None), (1003, "t", "long " * 9000 + "tail"), (1004, "abc", "abc"), (1004, "abc", "abc")]
    return spark.createDataFrame([(*r, None)[:4] for r in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return trigrams.write_index(docs, f"file://{tmp_path_factory.mktemp('index')}/at", buckets=7)


@pytest.mark.parametrize("query", QUERIES)
def test_index_gives_what_a_scan_gives(docs, index, query):
    want = sorted(map(tuple, search.search(docs, query, None).collect()), key=str)
    assert sorted(map(tuple, trigrams.search(index, query, None).collect()), key=str) == want
    assert [tuple(r) for r in trigrams.search(index, query, 7).collect()] == [tuple(r) for r in search.search(docs, query, 7).collect()] or len({r[0] for r in want}) < len(want)


def test_lists_of_the_terms_alone_are_read(index):
    plan = trigrams._of_grams(index.postings, ["abc"], 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)" in plan
    assert trigrams.candidates(index, "tail").count() == 1
    assert trigrams.candidates(index, "no-such-term").count() == 0


def test_segments_bound_the_lists(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "SEGMENT", 16)
    small = trigrams.write_index(docs, f"file://{tmp_path}/small", buckets=3)
    assert small.postings.agg(F.max("n")).first()[0] <= 16
    for query in ("abc", "b a", "ab é"):
        assert sorted(map(tuple, trigrams.search(small, query, None).collect()), key=str) == sorted(map(tuple, search.search(docs, query, None).collect()), key=str)


def test_index_of_no_documents(spark, docs, tmp_path):
    none = trigrams.write_index(docs.where("false").coalesce(1), f"file://{tmp_path}/none")
    assert trigrams.search(none, "abc").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def none_small(spark):
    """Spark sends no table to all tasks because it is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("query", ["abc", "a", "ABC ab"])
@pytest.mark.parametrize("most", [0, 50_000])
def test_texts_are_not_shuffled(docs, index, none_small, monkeypatch, query, most):
    monkeypatch.setattr(trigrams, "MOST_SENT", most, raising=False)
    found = trigrams.search(index, query, None)
    assert "SortMergeJoin" not in _plan(found) and "ShuffledHashJoin" not in _plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, search.search(docs, query, None).collect()), key=str)


def test_query_shuffles_no_texts_and_no_titles(spark, none_small):
    from loomwright.plans import catalog

    plan = _plan(catalog.QUERIES["trigram_search"](spark, "/root/testdata/sf0.001"))
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("longest,most", [(1 << 16, 1 << 22), (3, 1 << 22), (1 << 16, 9)])
def test_lists_hold_each_trigram_of_each_text_once(spark, monkeypatch, longest, most):
    monkeypatch.setattr(trigrams, "SEGMENT", longest)
    monkeypatch.setattr(trigrams, "MOST_PLACES", most)
    texts = ["\0", "abcabc", "x😀y😀", "a\nb\r c", "été", "z" * 50, "ab", "\0\0\0", "abc"]
    numbers = [5, 6, 7, 1 << 33, (1 << 33) + 1, (1 << 33) + (1 << 17), 0, 1, 2]  # as of tasks that read parts of several shards
    lists = trigrams._lists(spark.createDataFrame([*zip(numbers, texts)], "doc long, text string").coalesce(1))
    assert "Exchange" not in _plan(lists)
    rows = lists.collect()
    got = sorted((r.segment + p, r.gram) for r in rows for p in r.places)
    assert got == sorted((d, g) for d, t in zip(numbers, texts) for g in {(t + "\0\0")[i : i + 3] for i in range(len(t))})
    assert len({(r.gram, r.segment) for r in rows}) == len(rows) and all(r.n == len(r.places) and [*r.places] == sorted(r.places) and max(r.places) < longest for r in rows)
