import hashlib
import math
import random
import re
from pathlib import Path
from sys import path as where

import numpy as np
import pytest
from pyspark.sql import functions as F

where.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomwright.llm import fill_in_middle, hard_negatives, language_id  # noqa: E402

SAMPLE = [(0, None), (1, ""), (2, "a"), (3, "ab<P>cd"), (4, "x<S>"), (5, "<M>"), (6, "é€😀\n\r\0 z"), (7, "<" * 9 + ">P>S>"), (8, "long " * 30_000), (None, "no id at all"), (9, "tie"), (9, "tie"), (9, "other text"), (-3, "negative id")]
SAMPLE += [(100 + i, "".join(random.Random(i).choice("ab <>PSMé\U0001f600\n") for _ in range(i % 40))) for i in range(300)]


def middle(doc_id, text):
    """(n, form, prefix, middle, output) by slices."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def test_middle_against_slices(spark):
    docs = brute.clashing(brute.documents(spark, SAMPLE))
    rows = fill_in_middle.fill_in_middle(docs).withColumn("back", fill_in_middle.restore(F.col("form"), F.col("output"))).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_units), str(r.middle_units), r.output, r.back) for r in rows)
    want = []
    for d, t in SAMPLE:
        n, form, p, m, out = middle(d, t)
        want.append((str(d), n, form, str(p), str(m), out, t or ""))
    assert got == sorted(want)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.where("false")).count() == 0


def test_middle_of_other_units_and_bytes_that_are_no_text(spark):
    words = fill_in_middle.fill_in_middle(brute.documents(spark, SAMPLE), unit=r"\w+", plain=0, spm=100).collect()
    for r in words:
        if r.form != "plain":
            texts = [t for d, t in SAMPLE if d == r.doc_id and t]
            assert any(len(re.findall(r"\w+", t)) == r.n and r.output == f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" for t in texts for ends in [[0] + [m.end() for m in re.finditer(r"\w+", t)]] for a, b in [(ends[min(r.prefix_units, len(ends) - 1)], ends[min(r.prefix_units + r.middle_units, len(ends) - 1)])])
    raw = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62C3' as string)").alias("text"))
    out = fill_in_middle.fill_in_middle(raw, plain=0).select("n", F.hex(fill_in_middle.restore(F.col("form"), F.col("output")).cast("binary")).alias("back")).collect()
    assert {(r.n, r.back) for r in out} == {(4, "61FF62C3")}


def test_matcher_counts_and_ends():
    unit = re.compile(fill_in_middle.CODE_POINT)
    for t in ("", "a", "\n\n", "é😀x"):
        assert fill_in_middle.count_units(unit, t) == len(t)
        assert all(fill_in_middle.bounds(unit, t, a, b) == (a, b) for b in range(len(t) + 1) for a in range(b + 1))


def negatives(rows, positives=5, most=3):
    """Plain version; rows: (id, vector, label), ids distinct."""
    some = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            some.append((i, [math.floor(256 * float(x)) for x in v], label))
    out = set()
    for a, v, la in some:
        if a % 50:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), i, lb) for i, w, lb in some if i != a), key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == la][:positives]:
            inside = [s for s in scored if s[2] != la and 50 * p <= 100 * s[0] <= 95 * p]
            out |= {(a, i, k, j, p, s) for k, (s, j, _) in enumerate(inside[:most], 1)}
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, h int, g int, vec int"


def mined(df, **how):
    return {tuple(r) for r in hard_negatives.hard_negatives(df, **how).collect()}


def test_negatives_against_all_pairs(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.normal(size=(6, 10))
    rows = []
    for i in range(900):
        v = (centres[rng.integers(6)] + 0.4 * rng.normal(size=10)).astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(4))))
    rows += [(900 + i, rows[50][1], i % 3) for i in range(120)]  # ties
    rows += [(2000, [float("nan")] * 10, 1), (2050, None, 1), (2100, rows[0][1], None), (2150, [None] + [1.0] * 9, 1), (2200, [float("inf")] * 10, 2), (None, rows[0][1], 1), (2250, [0.5, 0.25], 1), (2300, [], 2), (2350, [1000.0] * 10, 3), (2351, [999.0] * 10, 3), (2352, [600.0] * 10, 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    want = negatives(rows)
    assert want and mined(df) == want
    assert mined(df, block_rows=100, block_anchors=7, sample=40) == want  # bounds of poor centres are wide, and the rows the same
    assert mined(df.union(df)) == want  # rows of one id are one item
    assert mined(df, positives=2, negatives=7) == negatives(rows, 2, 7)
    assert mined(df.where("false")) == set() and mined(df.where("label = 1")) == set()


def test_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.integers(-(1 << 20), 1 << 20, (500, 12)).astype(np.int32)
    books = hard_negatives.fit_codebooks(x[:30])
    block = hard_negatives.Rows(hard_negatives.Rows.pack(np.arange(500), np.zeros(500), x, books), 12)
    low, high = block.bounds(x[:40], books, slice(None))
    exact = x.astype(np.float64) @ x[:40].T
    assert (low <= exact).all() and (exact <= high).all() and (high - low < 2 * np.abs(exact).max()).any()
    fine = hard_negatives.fit_codebooks(x % 8)
    small = hard_negatives.Rows(hard_negatives.Rows.pack(np.arange(500), np.zeros(500), x % 8, fine), 12)
    low, high = small.bounds((x % 8)[:40], fine, slice(None))
    assert (high - low < 3).all()  # few distinct pairs: every centre is a row's own


def test_integer_bounds_of_windows():
    p = np.array([-7, -1, 0, 1, 3, 19, 20, 101])
    least, largest = hard_negatives.window(p)
    for a, lo, hi in zip(p.tolist(), least.tolist(), largest.tolist()):
        assert [n for n in range(-200, 200) if 50 * a <= 100 * n <= 95 * a] == list(range(lo, hi + 1))


WORDS = {"aa": "the and of thing with ought".split(), "bb": "der und sch ein ung mit".split(), "cc": "les que eau dans oux été".split(), "dd": "ción los ado ñar por ella".split(), "ee": "της και από στο είναι μία".split(), "ff": "не что это как для она".split(), "gg": "han yok bir çok için değil".split()}


def speech(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ",", " 12", "\n"]) for _ in range(n))


@pytest.mark.parametrize("langs", [2, 4, 7])
def test_languages_are_told_apart(spark, langs):
    rng = random.Random(langs)
    some = list(WORDS)[:langs]
    rows = [(i, speech(rng, some[i % langs], rng.choice((6, 20, 60))), some[i % langs]) for i in range(60 * langs)]
    rows += [(9000, None, "aa"), (9001, "", "bb"), (9002, " 12 ! \n", "aa"), (None, speech(rng, "aa", 50), None), (9003, speech(rng, "bb", 30_000), None), (9003, speech(rng, "bb", 30), None)]
    df = spark.createDataFrame([(i, t, x, 1, 2) for i, t, x in rows], "doc_id long, text string, lang string, x int, score int").repartition(4)
    model, measured = language_id.learn(df, learned=~language_id.held_out(F.col("doc_id")))
    assert model.langs == some
    got = {}
    for r in model.decide(measured).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    right = [got[i][0][0] == x for i, _, x in rows if i is not None and i < 9000]
    assert sum(right) >= 0.99 * len(right)
    assert all(got[i] == [("und", 0.0)] for i in (9000, 9001, 9002)) and got[None][0][0] == "aa" and [x for x, _ in got[9003]] == ["bb", "bb"]
    again = {(r.doc_id, r.lang_pred, round(r.score, 12)) for r in model.predict(df).collect()}
    assert again == {(i, x, round(s, 12)) for i, pairs in got.items() for x, s in pairs}


def test_languages_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "some words", "xx"), (2, "more words", None), (3, None, "yy"), (4, "...", "zz")], "doc_id long, text string, lang string")
    model, measured = language_id.learn(df.where("doc_id < 4"))
    assert model.langs == ["xx"]
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in model.decide(measured).collect()) == [(1, "xx", 1.0), (2, "xx", 1.0), (3, "und", 0.0)]
    model, measured = language_id.learn(df.where("false"))
    assert model.decide(measured).count() == 0 and [(r.lang_pred, r.score) for r in model.predict(df).collect()] == [("und", 0.0)] * 4
    model, measured = language_id.learn(df)  # a language without a letter is learned and never the better one by much
    assert model.langs == ["xx", "zz"] and {r.doc_id: r.lang_pred for r in model.decide(measured).collect()}[4] == "und"


def test_sequences_against_slices():
    for text in ("", "12 3", "a", "Ab c", " ab\ncd! é", "xyzzy " * 5):
        a = language_id.letters_of(text)
        words = re.findall(r"[^\W\d_]+", text.lower())
        assert "".join(map(chr, a)).replace("\0", " ") == (" " + " ".join(words) + " " if words else "")
        want = []
        for w in words:
            ended = "\0" + w + "\0"
            want += [ended[i : i + k] for k in range(1, language_id.GRAMS + 1) for i in range(len(ended) - k + 1)]
        want = sorted(x for x in want if x != "\0")
        name = {x: int(language_id.grams(np.array([ord(c) for c in x], np.uint32))[-1]) for x in want}
        assert sorted(name[x] for x in want) == sorted(language_id.grams(a).tolist())


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = speech(random.Random(1), "cc", 400).encode()
    whole = np.bincount(np.concatenate([language_id.grams(a) for a in language_id.pieces(text)]), minlength=language_id.BUCKETS)
    monkeypatch.setattr(language_id, "_PIECE", 97)
    parts = [language_id.grams(a) for a in language_id.pieces(text)]
    assert len(parts) > 10 and (np.bincount(np.concatenate(parts), minlength=language_id.BUCKETS) == whole).all()


def test_codewords_and_decoding():
    for n in (1, 2, 3, 4, 5, 6, 12, 40):
        code = language_id.codewords(n)
        assert len(code) == n and (n > 5 or code.shape[1] == max(0, 2 ** (n - 1) - 1))
        if n > 1:
            assert all((x != y).sum() >= max(1, code.shape[1] // 6) for i, x in enumerate(code) for y in code[:i]) and all(0 < c.sum() < n for c in code.T)
    code = language_id.codewords(4)
    odds = np.where(code[2], 3.0, -3.0)[None]
    odds[0, 1] *= -1  # one classifier errs
    best, score, near = language_id.decode(odds, code, np.ones(7))
    loss = [sum(math.log1p(math.exp(-(o if bit else -o))) for o, bit in zip(odds[0], word)) for word in code]
    assert best[0] == 2 == int(np.argmin(loss)) and not near[0] and abs(score[0] - math.exp(-loss[2]) / sum(math.exp(-x) for x in loss)) < 1e-9
    assert language_id.decode(np.zeros((1, 7)), code, np.ones(7))[2][0]  # all alike: ambiguous


def test_line_of_a_bit_against_gradient():
    x = np.linspace(-2, 2, 21)
    p = 1 / (1 + np.exp(-(1.5 * x - 0.4)))
    scale, bias, right = language_id.fit_line(x, 1e4 * p, 1e4 * (1 - p))
    assert abs(scale - 1.5) < 1e-3 and abs(bias + 0.4) < 1e-3 and 0.5 < right < 1
