import hashlib
import os
from pathlib import Path
from sys import path as where

import pytest

where.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from compare import rows_match  # noqa: E402

from loomwright.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    rows_match(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_pipeline_against_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    for d in list(held):
        n, chars, symbols, dup, repeat, lines = brute.rules(held[d])
        if n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 2 * dup > lines or not 2 * n <= chars <= 15 * n:
            del held[d]
    held = {d: kept for (d, text), kept in brute.lines(held.items()).items() if kept == text or kept.split()}
    held = {d: held[d] for d, (_, c) in brute.near(held.items(), 5).items() if d == c}
    cut = brute.substring(held.items())
    gone = hashlib.sha256(b"").hexdigest()
    held = {d: t for d, t in held.items() if not cut[d][1] or cut[d][2] != gone}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(held)
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    import numpy as np

    for d, ids in whole.items():
        text = tok.decode(np.frombuffer(ids, "<u4")[:-1].tolist())
        if cut[d][1]:
            assert hashlib.sha256(text.encode()).hexdigest() == cut[d][2]
        else:
            assert text == held[d]


def test_stage_contract(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_rows_that_share_an_id_lose_no_text(spark):
    import corpus_pipeline

    words = [f"w{i} x{i}" for i in range(60)]
    one, other, third = " ".join(words[:30]), " ".join(words[30:]), "apart " * 3 + "from all others here"
    rows = [(1, one), (1, one), (1, other), (2, third), (2, third), (3, one + " and more"), (None, third), (None, "nobody else says this")]
    docs = brute.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = sorted((str(r.doc_id), r.text, r.n_chars) for r in stage(spark, docs, SF).collect())
        assert all(n == len(t) for _, t, n in got)
        kept = [(d, t) for d, t, _ in got]
        if name == "near_dedup":
            assert kept.count(("1", other)) == 1 and len(kept) == 4
            assert sum(t == third for _, t in kept) == 1 and sum(t.startswith(one) for _, t in kept) == 1
        else:
            assert kept.count(("1", other)) == 1 and {w for _, t in kept for w in t.split()} == {w for _, t in rows for w in t.split()}
            assert all(t for _, t in kept) and (name == "substring_dedup" or kept.count(("1", one)) == 2)
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(80))
    for name, rows in (("none", []), ("odd", [(1, None), (2, ""), (3, good), (3, good), (4, good), (5, good + "\n" + "again " * 200)])):
        brute.clashing(brute.documents(spark, rows, 1) if rows else brute.documents(spark, [(1, "")], 1).where("false")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} == {3}
