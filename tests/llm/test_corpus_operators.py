import hashlib
import random
import re
import zlib
from pathlib import Path
from sys import path as where

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

where.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomwright.llm import bpe, exact_dedup, line_dedup, near_dedup, packing, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity  # noqa: E402
from loomwright.llm import tokens as T  # noqa: E402


def texts(seed=5, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 17 == 0:
            t = None if i % 2 else ""
        else:
            kind = rng.random()
            alphabet = ["a", "b", "c d", "e\tf"] if kind < 0.3 else [f"w{rng.randint(0, 400)}" for _ in range(200)]
            t = "".join(rng.choice(alphabet) + rng.choice([" ", " ", " ", "\n", "  ", ". "]) for _ in range(rng.choice((1, 2, 19, 20, 21, 60, 300))))
        out.append((i, t))
    full = [t for _, t in out if t and len(t) > 150]
    for i in range(n // 2):
        w = rng.choice(full).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "edited"
        out.append((1000 + i, " ".join(w)))
    out.append((5000, "x" * 30_000 + " long word"))
    out.append((5001, "long " * 20_000))
    return out


@pytest.fixture(scope="module")
def sample():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, sample):
    return brute.clashing(brute.documents(spark, sample)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_substring(docs, sample, empty):
    got = by_id(substring_dedup.dedup_substrings(docs, block_bytes=4000), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(sample)
    got = by_id(substring_dedup.dedup_substrings(docs, block_bytes=4000, hot=2), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(sample)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_phrase_with_very_many_surroundings(spark):
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(n))
    phrase = words(18)
    rows = [(i, f"{words(rng.randint(0, 15))} {rng.choice('xyz')} {rng.choice('xyz')} {phrase} {rng.choice('xyz')} {rng.choice('xyz')} {words(rng.randint(0, 15))}") for i in range(300)]
    got = by_id(substring_dedup.dedup_substrings(brute.documents(spark, rows, 6), block_bytes=1500), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(rows)


def test_substring_other_widths(spark, sample):
    some = [r for r in sample if r[0] < 5000]
    for width in (3, 7):
        got = by_id(substring_dedup.dedup_substrings(brute.documents(spark, some), width=width, block_bytes=9000), "n_words", "n_removed", "kept_sha256")
        assert got == brute.substring(some, width)


def test_suffix(docs, sample, empty):
    got = by_id(suffix_dedup.dedup_bytes(docs, block_bytes=9000), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(sample)
    got = by_id(suffix_dedup.dedup_bytes(docs, block_bytes=9000, hot=2), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(sample)
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_suffix_phrase_with_very_many_surroundings(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = noise(90)
    rows = [(i, noise(rng.randint(0, 60)) + rng.choice("xyz") * 8 + phrase + rng.choice("xyz") * 8 + noise(rng.randint(0, 60))) for i in range(300)]
    got = by_id(suffix_dedup.dedup_bytes(brute.documents(spark, rows, 6), block_bytes=1500), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(rows)


def kept_lines(df):
    return {(r.doc_id, r.text): r.kept for r in df.select("doc.doc_id", "doc.text", F.coalesce("kept_text", F.lit("")).alias("kept")).collect()}


def test_lines(spark, docs, sample, empty):
    rng = random.Random(9)
    some = [(i, None if i % 11 == 0 else "".join(rng.choice(["a\n", "b\n", "c\n", "d e\n", "\n", " \n", "x"]) for _ in range(rng.choice((0, 1, 4, 9, 60))))) for i in range(80)]
    for given, frame in ((some, brute.documents(spark, some)), (sample, docs)):
        for least, words in ((1, 1), (2, 3), (3, 1000), (4, 6), (5, 1000), (7, 9), (8, 5)) if given is some else ((4, 10),):
            assert kept_lines(line_dedup.dedup_lines(frame, min_lines=least, min_words=words)) == brute.lines(given, least, words)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_of_every_length(spark):
    """Three lines of twelve words go, two of nine stay, and a longer run is one run wherever its parts stood before."""
    three, two = ["one two three four", "five six seven eight", "nine ten eleven twelve"], ["a b c d", "e f g h i"]
    rows = [(1, three + ["x"] + two), (2, ["y"] + three + ["z"]), (3, two + ["q"]), (4, ["p0", "p1", "p2", "p3", "p4"]), (5, ["p1", "p2", "p3", "p4", "r1", "r2"]), (6, ["p0", "p1", "p2", "p3", "p4", "r1", "r2"])]
    docs = brute.documents(spark, [(i, "\n".join(x)) for i, x in rows])
    got = by_id(line_dedup.dedup_lines(docs).select("doc.doc_id", "n_removed", "n_runs", "longest", "kept_text"), "n_removed", "n_runs", "longest", "kept_text")
    assert got == {1: (0, 0, 0, "\n".join(rows[0][1])), 2: (3, 1, 3, "y\nz"), 3: (0, 0, 0, "\n".join(rows[2][1])), 4: (0, 0, 0, "\n".join(rows[3][1])), 5: (4, 1, 4, "r1\nr2"), 6: (7, 1, 7, "")}
    deep = {(r.doc_id, r.i): (r.run, r.run_words) for r in line_dedup.suffix_array(docs, depth=3).collect()}
    assert deep[2, 1] == (3, 12) and deep[2, 2] == (2, 8) and deep[3, 0] == (2, 9) and deep[6, 0] == (3, 3) and deep[1, 0] == (0, 0)


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a0\na1\na2\na3"), (1, "b0\nb1\nb2\nb3"), (3, "a0\nb1\na2\nb3"), (4, "a0\na1\na2\na3"), (5, "same\nlines\nin\nboth"), (5, "same\nlines\nin\nboth")]
    got = kept_lines(line_dedup.dedup_lines(brute.documents(spark, rows)))
    assert got[3, rows[2][1]] == rows[2][1] and got[1, rows[1][1]] == rows[1][1] and got[1, rows[0][1]] == rows[0][1]
    assert got[4, rows[3][1]] == "" and got[5, rows[4][1]] == rows[4][1]


def test_line_suffixes_are_sorted(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.choice((1, 5, 30))))) for i in range(30)]
    rows += [(100 + i, rows[i][1] + "\nend") for i in range(5)]
    got = line_dedup.suffix_array(brute.documents(spark, rows)).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(len(got)))
    texts_ = {d: t.split("\n") for d, t in rows}
    order = [texts_[r.doc_id][r.i :] for r in got]
    for depth in (1, 2, 3, 4, 7, 8):  # suffixes that begin alike stand side by side at every depth
        heads = [tuple(x[:depth]) for x in order if len(x) >= depth]
        assert len(set(heads)) == 1 + sum(a != b for a, b in zip(heads, heads[1:]))
    earlier = {}
    for d in sorted(texts_):
        for i in range(len(texts_[d])):
            for k in (1, 2, 4, 8, 16):
                if i + k <= len(texts_[d]):
                    earlier.setdefault(tuple(texts_[d][i : i + k]), (d, i))
    for r in got:
        mine = texts_[r.doc_id]
        want = max((k for k in (1, 2, 4, 8, 16) if r.i + k <= len(mine) and earlier[tuple(mine[r.i : r.i + k])] != (r.doc_id, r.i)), default=0)
        assert r.run == want


def test_near(docs, sample, empty):
    for size in (2, 5):
        got = by_id(near_dedup.near_duplicates(docs, shingle=size), "n_shingles", "component_id")
        assert got == brute.near(sample, size)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_regions_of_any_size_keep_copies_together():
    rng = np.random.default_rng(3)
    labels = np.zeros((700, near_dedup.DEPTH), np.uint16)
    labels[:, 5:] = rng.integers(0, 6, (700, 3))
    order = np.lexsort(labels.T[::-1])
    signs = np.tile(rng.integers(0, 16, 128).astype(np.uint8), (700, 1))
    signs[rng.integers(0, 700, 700), rng.integers(0, 128, 700)] = 3
    pairs = near_dedup.region_pairs(np.arange(700), labels[order], signs, 4)
    assert len(pairs) < 700 * 6
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {find(i) for i in range(700)} == {0}


def test_star_with_the_largest_id_as_hub_is_one_tree():
    signs = np.tile(np.arange(128) % 16, (3, 1)).astype(np.uint8)
    signs[0, :12] += 1  # each leaf is 0.90 like the hub, the leaves 0.80 like each other
    signs[1, 12:24] += 1
    pairs = near_dedup.region_pairs(np.array([1, 2, 3]), np.zeros((3, near_dedup.DEPTH), np.uint16), signs & 15, 4)
    assert {tuple(sorted(p)) for p in pairs} == {(1, 3), (2, 3)}


def test_large_groups_of_different_texts_near_the_threshold(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(1000):  # one shingle is a word: sets of 100, each alike 0.8 and more to some and less to others
        w = list(base)
        for k in rng.sample(range(100), rng.randint(5, 11)):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = by_id(near_dedup.near_duplicates(brute.documents(spark, rows), shingle=1), "component_id")
    sets = [set(t.split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x, y = find(i), find(j)
            if x != y:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[max(x, y)] = min(x, y)
    wrong = sum(got[i][0] != find(i) for i in range(len(rows)))
    assert wrong == 0 and len({find(i) for i in range(len(rows))}) > 1


@pytest.mark.parametrize("rows_of_block", [256, 16])
def test_true_pairs_among_many_that_nearly_are(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows_of_block)
    common = [f"c{i}" for i in range(1000)]
    rows = []
    for i in range(400):  # two of a pair 0.801, all others 0.792 alike
        rows.append((i, " ".join(common + [f"p{i // 2}_{k}" for k in range(6)] + [f"u{i}_{k}" for k in range(125)])))
    got = by_id(near_dedup.near_duplicates(brute.documents(spark, rows), shingle=1), "component_id", "kept")
    assert got == {i: (i - i % 2, i % 2 == 0) for i in range(400)}


def test_near_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (7, text), (7, "other words here"), (None, text), (None, "alone in the world"), (3, text + " more"), (9, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(brute.documents(spark, rows)).collect())
    assert got == [(False, 3, 47, 3, True), (False, 7, 1, 3, False), (False, 7, 46, 3, False), (False, 7, 46, 3, False), (False, 9, 0, 9, True), (True, 0, 1, None, True), (True, 0, 46, 3, False)]


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 7000, 3000, 0, 400)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_dedup.intersections(sets)
    assert all(got[i][j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_bpe_round_trip(docs, sample, empty):
    enc = T.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: (r.ids, bytes(r.text_bytes)) for r in bpe.encode_and_decode(docs, block_bytes=9000).collect()}
    assert got == {d: (enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in sample}
    digests = by_id(bpe.digests(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    for d, (ids, text) in got.items():
        assert digests[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert bpe.digests(empty).count() == 0


@pytest.mark.parametrize(("length", "weights"), [(1024, None), (64, {"s0": 1, "s1": 5}), (50, {"s2": 0})])
def test_packing(docs, sample, length, weights):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in sample}
    rows = packing.pack(docs, length=length, weights=weights, window_sequences=4, block_bytes=9000).collect()
    done = dict.fromkeys(ids, 0)
    sequences: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == done[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        done[r.doc_id] += r.length
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and bytes(r.ids) == piece
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {d: len(x) for d, x in ids.items()}
    sizes = []
    for s in range(len(sequences)):
        at = 0
        for offset, n in sorted(sequences[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == length for n in sizes[:-1]) and sizes[-1] <= length


def test_pretoken_of_more_than_65535_ids():
    text = "\u9f98" * 40_001
    enc = T.json_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    data = text.encode()
    starts, names, first, which = T.distinct_words(data, np.array([len(data)]))
    flat, counts = T.WordIds(enc.encode_ordinary).look_up(data, starts, names, first)
    assert len(starts) == 1 and counts[0] > 65_535
    assert T.take_lists(flat, counts, which).tolist() == enc.encode_ordinary(text)


def test_packing_of_added_tokens_odd_sources_and_rows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\u9f98" * 40_001, "", None, "same", "same", "tail  <|endoftext|>  \n"]
    sources = ["a\0b", "\1", None, "", "\1", "a\0b", None, "x", "x"]
    ids = [0, 1, 2, 3, 4, None, 6, 6, 8]
    docs = spark.createDataFrame(list(zip(ids, given, sources)), "doc_id long, text string, source string").repartition(3)
    for added in (True, False):
        tok.encode_special_tokens = not added
        whole: dict = {}
        for r in sorted(packing.pack(docs, length=16, window_sequences=2, added_tokens=added).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.source is None, r.source, r.start)):
            whole.setdefault((r.doc_id, r.source), b"")
            whole[r.doc_id, r.source] += bytes(r.ids)
        want = {(i, s): np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t, s in zip(ids, given, sources)}
        assert whole == want
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_of_very_many_sources_keeps_their_shares(spark):
    rows = [(i, "a b c d e f g h i", f"host{i % 2000}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(docs, length=100, window_sequences=80, block_bytes=20_000).collect()
    assert sum(r.length for r in got) == 80_000
    per: dict = {}
    for r in got:
        for place in range(r.sequence_id * 100 + r.offset, r.sequence_id * 100 + r.offset + r.length):
            per.setdefault(place // 8000, {}).setdefault(r.source, 0)
            per[place // 8000][r.source] += 1
    assert len(per) == 10 and all(len(w) == 2000 and set(w.values()) <= {3, 4, 5} for w in per.values())


def test_shares_are_exact_beyond_63_bits():
    part, whole = np.array([0, 1, 7, (1 << 45) - 3, 1 << 45]), 1 << 45
    for n in (0, 1, 12345, (1 << 44) + 7, 1 << 62):
        if n * (1 << 45) // whole < 1 << 63:
            assert packing._share(n, part, whole).tolist() == [n * int(x) // whole for x in part]


def test_windows_keep_the_proportions():
    s = packing.Schedule([700, 200, 100], None, 50)
    for w in range(1, s.windows + 1):
        step = [b - a for a, b in zip(s.given(w - 1).tolist(), s.given(w).tolist())]
        assert all(abs(x - 50 * share) <= 1 for x, share in zip(step, (0.7, 0.2, 0.1)))
    s = packing.Schedule([700, 200, 0, 10], [1, 1, 1, 0], 50)
    assert s.given(s.windows).tolist() == [700, 200, 0, 10]
    for q in (0, 1, 3):
        for x in range(s.totals[q]):
            w = s.window_of(q, x)
            assert s.given(w)[q] <= x < s.given(w + 1)[q]


@pytest.mark.parametrize("sent", [exact_dedup.MOST_SENT, 0])
def test_exact(docs, sample, empty, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "MOST_SENT", sent)
    groups: dict[bytes, list[int]] = {}
    for d, t in sample:
        b = (t or "").encode()
        norm = re.sub(rb"[\x20\x09-\x0D]+", b" ", b)
        groups.setdefault(norm, []).append(d)
    want = {d: (min(g), len(g), d == min(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g}
    assert by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_rows_without_id(spark):
    docs = brute.documents(spark, [(None, "a  b"), (4, "a\tb"), (4, "a b"), (9, "a b"), (None, "c"), (None, "c"), (None, "d")], 4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == [(False, 4, False, 4, 4, True), (False, 4, False, 4, 4, True), (False, 9, False, 4, 4, False), (True, 0, False, 4, 4, False), (True, 0, True, 0, 1, True), (True, 0, True, 0, 2, True), (True, 0, True, 0, 2, True)]


@pytest.mark.parametrize("bits", [20, 2])
def test_quality_rules(docs, sample, empty, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)  # two bits: prints clash, and the words decide
    some = docs.where("doc_id < 5000") if bits == 2 else docs
    got = by_id(quality_rules.ledger(some), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    assert got == {d: brute.rules(t) for d, t in sample if d in got} and len(got) >= len(sample) - 2
    assert quality_rules.ledger(empty).count() == 0


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "short"), (3, " ".join(["a b c"] * 60)), (4, " ".join(f"w{i}###" for i in range(70))), (5, None)]
    docs = brute.documents(spark, rows)
    entries = quality_rules.ledger(docs)
    assert by_id(quality_rules.apply_policy(entries), "kept") == {1: (True,), 2: (False,), 3: (False,), 4: (False,), 5: (False,)}
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    out = {r.rule: (r.n_failed, r.n_alone, r.n_kept_without) for r in quality_rules.ablations(entries).collect()}
    assert out["symbols"] == (1, 1, 2) and out["too_short"][0] == 2


def quality_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(600):
        n = rng.randint(40, 120)
        rows.append((i, " ".join(word() for _ in range(n)) + "." if i % 4 else " ".join(word() + " | ###" for _ in range(n))))
    return rows + [(900, None), (901, ""), (902, "   "), (None, "no id")]


def test_quality_model_learns_from_positives(spark):
    docs = brute.documents(spark, quality_rows())
    labels = docs.where("doc_id % 8 = 1").select("doc_id")
    x, w, prior = quality_model.model(docs, labels)
    got = by_id(quality_model.score(x, w), "score")
    assert 0.6 < prior < 0.9
    assert sum((got[i][0] >= 0.5) == (i % 4 > 0) for i in range(600)) > 590
    assert all(0 <= s <= 1 for (s,) in got.values()) and len(got) == 604
    x, w, _ = quality_model.model(docs, labels.where("false"))
    assert not w.any() and x.count() == 604
    x, w, _ = quality_model.model(docs.where("false"), labels)
    assert quality_model.score(x, w).count() == 0


def test_quality_words_tell_texts_of_one_form_apart(spark):
    rng = random.Random(5)
    good, bad = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(800)]
    docs = brute.documents(spark, rows)
    x, w, prior = quality_model.model(docs, docs.where("doc_id % 6 = 1").select("doc_id"))
    got = by_id(quality_model.score(x, w), "score")
    assert sum((got[i][0] >= 0.5) == (i % 2 == 1) for i in range(800)) > 780 and 0.4 < prior < 0.6


def test_quality_fit_against_plain_version(spark):
    docs = brute.documents(spark, quality_rows(8))
    rows = quality_model.features(docs, np.arange(1, 600, 8)).cache()
    held = rows.collect()
    x, good = np.array([r.x for r in held]), np.array([r.good for r in held])
    assert good.sum() == 75
    d = x.shape[1]

    def plain_risk(w, prior):  # straight from the definition
        loss = lambda z: np.logaddexp(0, -z)
        z = x @ w
        return prior * loss(z[good]).mean() + max(0.0, loss(-z).mean() - prior * loss(-z[good]).mean())

    rng = np.random.default_rng(1)
    for prior in (0.3, 0.75):
        w = rng.normal(size=d) * 0.3
        u, p = quality_model._sums(rows, w)
        slope = u.slope / u.n - prior * p.x / p.n
        for i in range(d):
            step = np.eye(d)[i] * 1e-6
            assert u.loss / u.n < prior * p.loss / p.n or abs((plain_risk(w + step, prior) - plain_risk(w - step, prior)) / 2e-6 - slope[i]) < 1e-5
        gather = lambda w: (quality_model.Sums(quality_model.sums_of(x, w), d), quality_model.Sums(quality_model.sums_of(x[good], w), d))
        fitted, plain = quality_model.fit(rows, prior), quality_model.newton(gather, d, prior)
        assert np.allclose(fitted, plain, rtol=1e-4, atol=1e-4)
        assert plain_risk(fitted, prior) <= min(plain_risk(np.zeros(d), prior), plain_risk(w, prior)) + 1e-9


def test_least_ratio_is_the_dilution():
    good = np.array([0, 0, 100, 300, 600.0])
    mixed = 0.4 * good / good.sum() * 50_000 + np.array([10_000, 15_000, 5_000, 0, 0])
    assert abs(quality_model.least_ratio(mixed, good * 100) - 0.4) < 0.02


def letter_counts(words):
    code = toxicity._code[np.frombuffer(("  " + "  ".join(words) + "  ").encode(), np.uint8)]
    return np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3).reshape(27, 27, 27).astype(float)


WORDS = "idiot moron stupid worthless loser trash then thing other reader better letters asshole ass fuck shit a".split()


def test_restoring_disguised_words():
    restore = toxicity.Restorer(letter_counts(WORDS * 50)).restore
    for given, want in {"1d10t": "idiot", "id10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "looooser": "loser", "tr@sh": "trash", "l053r": "loser", "a$$": "ass", "@$$hole": "asshole", "a$$hole": "asshole", "$#!t": "shit", "f**k": "fuck", "f*ck": "fuck"}.items():
        assert want in restore(toxicity.core(given), False), given
    for given, want in {"i d i o t": "idiot", "w.o.r.t.h.l.e.s.s": "worthless", "a s s": "ass", "f  u  c  k": "fuck", "i d 1 0 t": "idiot", "a  l o s e r": "a loser"}.items():
        assert want in restore(given, True), given


def test_signs_at_ends_and_letters_of_other_forms():
    restore = toxicity.Restorer(letter_counts(WORDS * 50)).restore
    for given, want in {"a$$$": "ass", "@$$$": "ass", "a$$$$": "ass", "tra$h$$$": "trash", "l0ser***": "loser", "idio###": "idio###"}.items():
        assert toxicity.core(given) == given and want in (given, *restore(given, False)), given
    assert toxicity.plain_letters("ｆＵck ѕhіt Ѕtuріd") == "fuck shit stupid"
    assert toxicity.plain_letters("Это слово НЕ меняется, Été") == "это слово не меняется, été"


def test_spans_that_may_be_disguised():
    text = "plain words 1d10t and m o r o n or sooo 12 wow! \"$tupid (maybe) a s s 2024 f  u  c  k @$$ 3,000 l o\ns e r x".encode()
    words, spaced = toxicity.disguised(np.frombuffer(text, np.uint8), np.array([len(text)]))
    assert [x for a, b in words if (x := toxicity.core(text[a:b].decode()))] == ["1d10t", "sooo", "$tupid", "@$$"]
    assert [text[a:b] for a, b in spaced] == [b"m o r o n", b"a s s", b"f  u  c  k", b"s e r x"]
    two = toxicity.disguised(np.frombuffer(b"a b c d", np.uint8), np.array([3, 7]))
    assert two == ([], [])


def test_decoding_against_all_paths():
    restorer = toxicity.Restorer(letter_counts(WORDS * 3))
    rng = random.Random(6)
    for spaced in (False, True):
        for _ in range(60):
            stretch = (" " if spaced else "").join(rng.choice("abst10$!@oo") for _ in range(rng.randint(1, 6))) + rng.choice(["", "ooo"] if not spaced else [""])
            for literal in (True, False):
                columns = restorer.lattice(stretch, spaced, literal)
                paths = [((0, 0), 0.0, "")]
                for choices, none in columns:
                    paths = [((y, k), w + restorer.log[x, y, k] + extra, said + out) for (x, y), w, said in paths for k, out, extra in choices] + ([(s, w + none, said) for s, w, said in paths] if none is not None else [])
                best = max(w + restorer.log[x, y, 0] for (x, y), w, _ in paths)
                got = restorer.decode(columns)
                assert any(said == got and abs(w + restorer.log[x, y, 0] - best) < 1e-9 for (x, y), w, said in paths)


def test_gradient_and_fit_of_the_logistic_score():
    rng = np.random.default_rng(4)
    owner, column = np.nonzero(rng.random((60, 7)) < 0.4)
    y, times = rng.integers(0, 2, 60).astype(float), rng.integers(1, 4, 60).astype(float)
    w, bias = rng.normal(size=7), 0.3
    value, gw, gb = toxicity.risk(w, bias, owner, column, y, times)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert abs((toxicity.risk(w + step, bias, owner, column, y, times)[0] - value) / 1e-6 - gw[i]) < 1e-5
    assert abs((toxicity.risk(w, bias + 1e-6, owner, column, y, times)[0] - value) / 1e-6 - gb) < 1e-5
    x = np.zeros((60, 8))
    x[owner, column] = 1
    x[:, 7] = 1
    plain = np.zeros(8)  # Newton steps on the dense matrix
    ridge = toxicity.RIDGE * np.diag([1.0] * 7 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ plain))
        plain -= np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x / times.sum() + ridge, x.T @ (times * (p - y)) / times.sum() + ridge @ plain)
    fitted, fitted_bias = toxicity.logistic(owner, column, y, times, 7, 5000)
    assert np.allclose([*fitted, fitted_bias], plain, atol=0.02)


def test_toxicity_finds_plain_and_disguised_words(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice(["th", "er", "on", "in", "re", "es"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, " ".join(clean[:40]) + " m0r0n"), (1001, " ".join(clean[40:80])), (1002, None), (1003, "")]
    docs = brute.documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = by_id(model.score(docs), "score")
    assert sum((got[i][0] >= 0.5) == (i % 4 == 0) for i in range(400)) >= 396
    assert got[1000][0] >= 0.5 > got[1001][0] and got[1002] == got[1003] and len(got) == 404
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).score(docs).count() == 404


def test_contents_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = brute.documents(spark, [(1, text), (1, text), (2, text), (None, text), (3, "short"), (3, "short")])
    gone = {f: sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in f(docs).collect()) for f in (substring_dedup.dedup_substrings, suffix_dedup.dedup_bytes)}
    # The row without an id counts as the least, so it stays; of the others all later copies go.
    assert gone[substring_dedup.dedup_substrings] == [(False, 1, 40), (False, 1, 40), (False, 2, 40), (False, 3, 0), (False, 3, 0), (True, 0, 0)]
    assert [n > 0 for _, _, n in gone[suffix_dedup.dedup_bytes]] == [True, True, True, False, False, False]
    ids = [tuple(r.ids) for r in bpe.encode_and_decode(docs).where("doc_id = 1 or doc_id is null").collect()]
    assert len(ids) == 3 and len(set(ids)) == 1
    assert len({tuple(r.x) for r in quality_model.features(docs.where("doc_id = 3"), np.array([], np.int64)).collect()}) == 1
    assert sorted(r.length for r in packing.pack(docs.where("doc_id = 3")).collect()) == [2, 2]
    assert {(r.n_words, r.failed) for r in quality_rules.ledger(docs.where("doc_id = 3")).collect()} == {(1, quality_rules.mask_of(("too_short",)))}


def test_toxicity_of_odd_tables(spark):
    docs = brute.documents(spark, [(1, "fine words here"), (1, "fine words here"), (None, "fine words here"), (2, None)])
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    got = model.score(docs).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score < 0.5 and sum(r.doc_id is None for r in got) == 1
    assert model.score(docs.where("false")).count() == 0
    assert toxicity.fit(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).score(docs).count() == 4


def test_repeated_rows_and_ties(spark):
    docs = brute.documents(spark, [(1, "same text here"), (2, "same text here"), (2, "same text here"), (3, "other")])
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size").collect()) == [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 1)]
    assert near_dedup.near_duplicates(docs).count() == 4
    for f in (substring_dedup.dedup_substrings, suffix_dedup.dedup_bytes, bpe.digests, quality_rules.ledger, lambda d: quality_model.features(d, np.array([2])), line_dedup.dedup_lines):
        assert f(docs).count() == 4


def test_suffix_texts_are_written_once(docs):
    """No table of the texts stands beside the shuffle that all rounds read."""
    from loomwright.llm.scratch import mark

    before = mark()
    assert suffix_dedup.dedup_bytes(docs, block_bytes=9000).count() > 0
    assert mark() == before


def _shuffled(spark) -> int:
    """Bytes that the session's shuffles have written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("copies", [False, True])
def test_suffix_moves_little(spark, copies):
    """Windows of a phrase that stands in different surroundings go by name, and bytes of stretches that are equal everywhere do not go."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    same = noise(3000 if copies else 80)
    rows = [(i, same + noise(50) if copies else noise(200) + same + noise(200)) for i in range(60 if copies else 300)]
    before = _shuffled(spark)
    got = by_id(suffix_dedup.dedup_bytes(brute.documents(spark, rows, 6), block_bytes=24000 if copies else 500, buckets=32), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    moved = (_shuffled(spark) - before) / sum(len(x) for _, x in rows)
    assert got == brute.suffix(rows)
    assert moved < (1.3 if copies else 8), moved


def test_suffix_rows_of_one_id_in_different_blocks(spark):
    """Of rows with one id and equal texts one stays whole, wherever they stand."""
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(700))
    docs = brute.documents(spark, [(7, text)] * 6, 6)
    for hot in (64, 1):
        got = sorted(r.n_removed for r in suffix_dedup.dedup_bytes(docs, block_bytes=500, hot=hot).collect())
        assert got == [0, 700, 700, 700, 700, 700], got
