"""Toxicity with noisy-channel deobfuscation.

A character language model is counted over every document. What may be disguised goes to the decoder: every word that holds a
look-alike sign (at its ends only if it is no common punctuation there), a letter three times or more in a row, and three or
more single letters or signs with separators between them. Such a stretch becomes a lattice: at each place the letters that the
sign may stand for and the sign itself (from the third of equal signs on also nothing), of a letter's run one or two, between
single letters nothing or the end of a word. Viterbi decoding takes the path with the best product of channel and language
model, once with signs as themselves among the choices, once without, and once more without runs of three or more equal signs at
its ends. The restored words are scored along with the text's own words, so a sign that means itself costs nothing.

Full-width letters are read as plain ones, and so are Cyrillic look-alikes in words that mix both scripts. Not looked at are words
cut in two by one space and letters doubled once in a word without signs.

The score is a logistic one over which words and word beginnings a text has. Features are those that occur in some toxic texts
that may be learned from (5 of them, or a twentieth if there are fewer than 100, but 2 at least) and hardly in others. At most
MOST_ROWS labelled rows of each kind are learned from, which bounds what the driver holds: the names that occur in several toxic
ones of these rows.

Null and empty texts have no features and get the score of the bias alone. Repeated rows, and rows of one id, are scored each,
equal texts with equal scores; a null id stays null. Very long texts are read whole. An empty table gives no rows, and without
labels all scores are 0.5 or less. Extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K
from loomwright.llm.scratch import settle

MOST_ROWS = 20_000
MIN_RATIO = 8.0
RIDGE = 2e-5
PREFIXES = (4, 5, 6, 7)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Signs and the letters that they may stand for.
LOOKALIKES = {"@": "a", "4": "a", "8": "b", "(": "c", "<": "c", "3": "e", "€": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z", "*": LETTERS}
SEPARATORS = " .-_*,/"
#: Signs that stand alone between separators, and punctuation that words begin and end with.
SINGLE = "0123456789$@!"
OPENING, CLOSING = "\"'`([{<", "\"'`.,;:!?)]}>"
#: Log weights of the channel: a sign for a letter, a sign as itself within a word and at its ends, a doubled letter, a new word.
_AS_LETTER, _AS_ITSELF, _AT_END, _TWICE, _BREAK = -1.0, -3.0, -0.5, -0.7, -2.0

#: Letters of another script that look like a letter a to z.
CYRILLIC = {"а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x"}
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}  # full-width forms
_wide = re.compile("[\uff01-\uff5e]")
_twins = "".join(CYRILLIC)
_mixed = re.compile(f"[^\\W\\d_]*(?:[a-z][{_twins}]|[{_twins}][a-z])[^\\W\\d_]*")
_ENDS = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
#: Columns of a lattice's end whose tables are kept.
TAIL = 8

_code = np.zeros(256, np.int64)  # 0 is any other byte, 1 .. 26 the letters
for _i, _c in enumerate(LETTERS, 1):
    _code[ord(_c)] = _code[ord(_c.upper())] = _i
_sign = np.zeros(256, bool)
_sign[[ord(c) for c in LOOKALIKES if ord(c) < 128] + [0xE2]] = True  # 0xE2 begins the one sign that is not ASCII, among others
_separator = np.zeros(256, bool)
_separator[[ord(c) for c in SEPARATORS]] = True
_single = np.zeros(256, bool)
_single[[ord(c) for c in LETTERS + SINGLE]] = True
_solid = np.zeros(256, bool)  # bytes of words: letters, digits and everything beyond ASCII
_solid[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_letter = _solid.copy()
_letter[48:58] = False


def count_characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Counts [27, 27, 27] of letter triples over all texts; index 0 is anything that is no letter a to z."""

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for _, rows in B.grouped(batches, B.BLOCK_BYTES):
            c = _code[np.frombuffer(b"\n\n" + b"\n\n".join(r[1] for r in rows) + b"\n\n", np.uint8)]
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(27**3), pa.int32()), "n": pa.array(total)})

    out = np.zeros(27**3)
    for r in B.document_rows(docs, id_col, text_col).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out.reshape(27, 27, 27)


#: Choices (code, output, log weight) of a place, and the log weight of no output at all, if it may be.
Column_ = tuple[tuple[tuple[int, str, float], ...], float | None]


class Restorer:
    """Viterbi decoding of one stretch under letter triples.

    The places before the first sign have one choice each and are walked by the few states that live. From the first sign on,
    tables hold the best rest for every pair of codes before it; those of the last TAIL places are kept, since many words end alike.
    """

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.1 + 5 * counts.sum(axis=0, keepdims=True) / max(1.0, counts.sum()) * 27
        self.log = np.log(smooth / smooth.sum(axis=2, keepdims=True))
        self.cells = self.log.tolist()
        self.restore = lru_cache(100_000)(self._restore)
        self.tail = lru_cache(4_096)(self._tail)

    def lattice(self, stretch: str, spaced: bool, literal: bool) -> list[Column_]:
        """Columns of (code, output, log weight) choices, and the log weight of no output at all, if it may be."""
        out: list[Column_] = []
        gaps = [len(m) for m in re.findall(f"[{re.escape(SEPARATORS)}]+", stretch)] if spaced else []
        i = 0
        while i < len(stretch):
            c, j = stretch[i], i + 1
            if spaced and c in SEPARATORS:
                while j < len(stretch) and stretch[j] in SEPARATORS:
                    j += 1
                out.append((((0, " ", 0.0 if j - i > min(gaps) else _BREAK),), 0.0))
            elif c in LOOKALIKES:
                choices = [(ord(x) - 96, x, _AS_LETTER) for x in LOOKALIKES[c]]
                if literal:
                    choices.append((0, c, _AT_END if i == 0 or j == len(stretch) else _AS_ITSELF))
                out.append((tuple(choices), _TWICE if stretch[max(0, i - 2) : i] == 2 * c else None))
            else:
                code = ord(c) - 96 if "a" <= c <= "z" else 0
                while j < len(stretch) and stretch[j] == c:
                    j += 1
                out.append((((code, c, 0.0),), None))
                if j - i > 1:
                    out.append((((code, c, _TWICE),), 0.0))
            i = j
        return out

    def _before(self, column: Column_, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the last two codes: the best log weight from a column on, and its choice there (-1 for no output), if rest is what follows."""
        choices, none = column
        codes = [code for code, _, _ in choices]
        via = self.log[:, :, codes] + (rest[:, codes] + np.array([weight for _, _, weight in choices]))[None]
        pick = via.argmax(axis=2).astype(np.int8)
        best = via.max(axis=2)
        if none is not None:
            stay = rest + none > best
            best, pick = np.where(stay, rest + none, best), np.where(stay, np.int8(-1), pick)
        return best, pick

    def _tail(self, columns: tuple[Column_, ...]) -> tuple[np.ndarray, np.ndarray | None]:
        return self._before(columns[0], self.tail(columns[1:])[0]) if columns else (self.log[:, :, 0], None)

    def decode(self, columns: list[Column_]) -> str:
        """The outputs of the best path."""
        at = next((i for i, (choices, _) in enumerate(columns) if len(choices) > 1), len(columns))
        live = {(0, 0): (0.0, "")}
        for ((code, text, weight),), none in columns[:at]:
            after = {}
            for (x, y), (total, said) in live.items():
                step = total + self.cells[x][y][code] + weight
                if step > after.get((y, code), (-np.inf,))[0]:
                    after[y, code] = step, said + text
                if none is not None and total + none > after.get((x, y), (-np.inf,))[0]:
                    after[x, y] = total + none, said
            live = after
        n = len(columns)
        best, _ = self.tail(tuple(columns[max(at, n - TAIL) :]))
        picks = [self.tail(tuple(columns[j:]))[1] for j in range(n - 1, max(at, n - TAIL) - 1, -1)]  # from the last place back
        for column in reversed(columns[at : max(at, n - TAIL)]):
            best, pick = self._before(column, best)
            picks.append(pick)
        (x, y), (_, said) = max(live.items(), key=lambda item: item[1][0] + best[item[0]])
        out = [said]
        for (choices, _), pick in zip(columns[at:], reversed(picks), strict=True):
            k = int(pick[x, y])
            if k >= 0:
                out.append(choices[k][1])
                x, y = y, choices[k][0]
        return "".join(out)

    def _restore(self, stretch: str, spaced: bool) -> tuple[str, ...]:
        """What a stretch may say: with signs as themselves among the choices, without, and without runs of equal signs at its ends."""
        bare = stretch if spaced else _ENDS.sub("", stretch)
        readings = [(stretch, True), (stretch, False)] + ([(bare, False)] if bare not in (stretch, "") else [])
        found = [self.decode(self.lattice(x, spaced, literal)) for x, literal in readings]
        return tuple(x for x in dict.fromkeys(found) if x != stretch)


def core(word: str) -> str:
    """A word without the punctuation around it, or the empty string if nothing in it looks disguised."""
    word = word.lstrip(OPENING).rstrip(CLOSING)
    if len(word) > 2 and word[0] == word[-1] == "*":
        word = word.strip("*")
    signs = [c for c in word if c in LOOKALIKES]
    if any(c.isalpha() for c in word):
        return word if signs or any(a == b == c and c.isalpha() for a, b, c in zip(word, word[1:], word[2:])) else ""
    return word if len(word) > 2 and len(set(word)) > 1 and sum(not c.isdigit() for c in signs) > 1 else ""


def disguised(a: np.ndarray, cuts: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans of lower-case text that may be disguised words, and of single letters between separators; none crosses a cut."""
    n = len(a)
    if n < 3:
        return [], []
    starts, ends = K.words(a, cuts)
    letter, sign = _letter[a], _sign[a]
    mark = np.zeros(n, bool)
    mark[1:] = sign[1:] & (letter[:-1] | sign[:-1])
    mark[:-1] |= sign[:-1] & (letter[1:] | sign[1:])
    mark[2:] |= (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & letter[2:] & (a[2:] < 128)
    held = np.concatenate(([0], np.cumsum(mark)))
    some = held[ends] > held[starts]
    words = list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))
    alone = _single[a]
    firm = _solid[a] | sign
    alone[1:] &= ~firm[:-1]
    alone[:-1] &= ~firm[1:]
    at = np.flatnonzero(alone)
    spaced = []
    if len(at) >= 3:
        doc = np.searchsorted(cuts, at, side="right")
        gap = np.concatenate(([0], np.cumsum(_separator[a])))
        near = (np.diff(at) <= 4) & (doc[1:] == doc[:-1]) & (gap[at[1:]] - gap[at[:-1] + 1] == np.diff(at) - 1)
        cut = np.flatnonzero(np.concatenate(([True], ~near)))
        size = np.diff(np.append(cut, len(at)))
        letters = np.add.reduceat(letter[at].astype(np.int64), cut)
        some = (size >= 3) & (letters >= 2)
        spaced = [(int(at[i]), int(at[i + k - 1]) + 1) for i, k in zip(cut[some].tolist(), size[some].tolist(), strict=True)]
    return words, spaced


def plain_letters(text: str) -> str:
    """Lower case; full-width forms, and look-alikes of another script in words that have letters a to z beside them, as those letters."""
    if not text.isascii():
        if _wide.search(text):
            text = text.translate(_WIDE)
        text = text.lower()
        return _mixed.sub(lambda m: "".join(CYRILLIC.get(c, c) for c in m[0]), text) if any(c in text for c in _twins) else text
    return text.lower()


def _lowered(rows) -> tuple[bytes, np.ndarray]:
    texts = [plain_letters(r[1].decode("utf-8", "replace")).encode() for r in rows]
    return b"".join(texts), np.cumsum(np.array([len(t) for t in texts], np.int64))


def _solid_words(a: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.ones(len(a) + 1, bool)
    edge[1:-1] = _solid[a[1:]] != _solid[a[:-1]]
    edge[cuts] = True
    at = np.flatnonzero(edge)
    keep = _solid[a[at[:-1]]] if len(a) else np.empty(0, bool)
    return at[:-1][keep], at[1:][keep]


def _feature_names(a: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(feature names, number of the word) for whole words and for beginnings of longer words."""
    for lo in range(0, len(starts), 1 << 18):
        s, e = starts[lo : lo + (1 << 18)], ends[lo : lo + (1 << 18)]
        codes = K.prefix_codes(a[s[0] : e[-1]])
        s, e = s - s[0], e - s[0]
        yield K.spans(codes, s, e), lo + np.arange(len(s))
        for k in PREFIXES:
            long_ = np.flatnonzero(e - s > k)
            yield K.mix(K.spans(codes, s[long_], s[long_] + k) + np.uint64(k)), lo + long_


def text_features(rows, restorer: Restorer):
    """(names, document numbers) pieces over the texts' own words and the restored ones."""
    text, cuts = _lowered(rows)
    a = np.frombuffer(text, np.uint8)
    starts, ends = _solid_words(a, cuts)
    doc = np.searchsorted(cuts, starts, side="right")
    for names, words in _feature_names(a, starts, ends):
        yield names, doc[words]
    restored, owner = [], []
    words, spaced = disguised(a, cuts)
    for spans, apart in ((words, False), (spaced, True)):
        for x, y in spans:
            stretch = text[x:y].decode("utf-8", "replace")
            stretch = stretch if apart else core(stretch)
            for said in restorer.restore(stretch, apart) if stretch else ():
                restored.append(said.encode())
                owner.append(int(np.searchsorted(cuts, x, side="right")))
    if restored:
        b = np.frombuffer(b" ".join(restored), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in restored])
        starts, stops = _solid_words(b, np.empty(0, np.int64))
        for names, words in _feature_names(b, starts, stops):
            yield names, np.array(owner)[np.searchsorted(ends, starts[words], side="right")]


def _feature_rows(docs: DataFrame, counts: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, names): distinct features of each text; of wanted alone if given. docs: doc_id, text."""

    def run(batches):
        restorer = Restorer(counts)
        for _, rows in B.grouped(batches, B.BLOCK_BYTES // 2):
            names, owner = [], []
            for x, d in text_features(rows, restorer):
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, x), len(wanted) - 1) if len(wanted) else np.zeros(len(x), np.int64)
                    hit = wanted[at] == x if len(wanted) else np.zeros(len(x), bool)
                    x, d = x[hit], d[hit]
                names.append(x)
                owner.append(d)
            x = np.concatenate(names) if names else np.empty(0, np.uint64)
            d = np.concatenate(owner) if owner else np.empty(0, np.int64)
            order = np.lexsort((x, d))
            x, d = x[order], d[order]
            if len(x):
                fresh = np.append(True, (x[1:] != x[:-1]) | (d[1:] != d[:-1]))
                x, d = x[fresh], d[fresh]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(rows))))) if len(rows) else [0]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "names": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64)))})

    return docs.mapInArrow(run, "doc_id long, names array<long>")


class ToxicityModel:
    def __init__(self, counts: np.ndarray, names: np.ndarray, weights: np.ndarray, bias: float):
        self.counts, self.names, self.weights, self.bias = counts, names, weights, bias

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score for every text."""
        names, weights, bias, counts = self.names, self.weights, self.bias, self.counts
        found = _feature_rows(B.document_rows(docs, id_col, text_col), counts, names)

        def run(batches):
            for batch in batches:
                lists = batch.column("names")
                flat = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                total = np.full(batch.num_rows, bias)
                if len(flat):
                    total += np.bincount(owner, weights=weights[np.searchsorted(names, flat)], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))))], names=["doc_id", "score"])

        return found.mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> ToxicityModel:
    """labels: doc_id, toxic; only these are learned from."""
    counts = count_characters(docs, id_col, text_col)
    sample = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for t in (1, 0)]
    chosen = settle(sample[0].union(sample[1]).select("doc_id", "toxic"), "labelled")
    texts = settle(B.document_rows(docs, id_col, text_col).join(chosen, "doc_id").select("doc_id", "text", "toxic"), "labelled-texts")
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    empty = ToxicityModel(counts, np.empty(0, np.uint64), np.empty(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n1:
        return empty
    least = min(5, max(2, n1 // 20))  # toxic texts that a feature occurs in
    toxic = _feature_rows(texts.where("toxic = 1").select("doc_id", "text"), counts, None).select(F.explode("names").alias("name")).groupBy("name").count().where(F.col("count") >= least)
    often = np.sort(np.array([r.name for r in toxic.select("name").collect()], np.int64).view(np.uint64))
    found = settle(_feature_rows(texts.select("doc_id", "text"), counts, often), "found").join(chosen, "doc_id")
    both = found.select(F.explode("names").alias("name"), "toxic").groupBy("name").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("k1"), F.sum((F.col("toxic") == 0).cast("long")).alias("k0"))
    ratio = (F.col("k1") + 0.1) / n1 / ((F.col("k0") + 0.1) / max(1, n0))
    picked = both.where((ratio >= MIN_RATIO) & (F.col("k1") >= least)).select("name").collect()
    if not picked:
        return empty
    names = np.sort(np.array([r.name for r in picked], np.int64).view(np.uint64))
    wanted = names

    def narrow(batches):
        for batch in batches:
            lists = [x for x in batch.column("names").to_pylist()]
            out = [[int(i) for i in np.flatnonzero(np.isin(wanted, np.array(x, np.int64).view(np.uint64)))] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "at"])

    rows = found.select("toxic", "names").mapInArrow(narrow, "toxic int, at array<int>").groupBy("at", "toxic").count().collect()
    y = np.array([r.toxic for r in rows], float)
    times = np.array([r["count"] for r in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    column = np.array([i for r in rows for i in r["at"]], np.int64)
    return ToxicityModel(counts, names, *logistic(owner, column, y, times, len(names)))


def risk(w: np.ndarray, bias: float, owner: np.ndarray, column: np.ndarray, y: np.ndarray, times: np.ndarray):
    """Mean logistic loss with its ridge, and its gradient; row i has the columns whose owner is i, and stands `times` times."""
    z = bias + np.bincount(owner, weights=w[column], minlength=len(y))
    g = times * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / times.sum()
    return (times * (np.logaddexp(0, z) - y * z)).sum() / times.sum() + RIDGE / 2 * (w**2).sum(), np.bincount(column, weights=g[owner], minlength=len(w)) + RIDGE * w, g.sum()


def logistic(owner: np.ndarray, column: np.ndarray, y: np.ndarray, times: np.ndarray, n: int, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with rates of their own."""
    w, bias = np.zeros(n), float(np.log(((times * y).sum() + 0.5) / ((times * (1 - y)).sum() + 0.5)))
    speed_w, speed_b = np.zeros(n), 0.0
    for _ in range(steps):
        _, gw, gb = risk(w, bias, owner, column, y, times)
        speed_w, speed_b = speed_w + gw**2, speed_b + gb**2
        w, bias = w - 0.3 * gw / np.sqrt(speed_w + 1e-12), bias - 0.3 * gb / np.sqrt(speed_b + 1e-12)
    return w, bias


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~out & F.col("toxic").isNotNull())
    return fit(docs, labels).score(docs).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
