"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits, and each bit a binary classifier of its own that tells the languages with a 1 from
those with a 0. Up to five languages get every way to split them in two (2 ** (n - 1) - 1 bits), more of them the most distant of
many drawn codes. A classifier weighs a text's letter sequences (1 to GRAMS letters of words in lower case, their ends marked) by
the log ratio of their shares on either side; sequences fall in BUCKETS buckets by hash. The counts behind the weights are
those of all texts that may be learned from, gathered by Spark in levels of sums. A second pass over these texts turns a bit's mean
weight into log odds (a scale and a bias for each bit, from counts by value).

Decoding takes the language whose codeword has the least loss: the sum over the bits of log(1 + exp(-margin)), each weighted by how
well its classifier told the sides apart. The score is the share of exp(-loss) that the language has; a text is ambiguous if
another codeword comes within MARGIN of the least loss. Ties go to the smaller language name.

Null texts and texts without a letter are `und` with score 0; texts whose sequences were never seen have the bias of each bit to
go by. Without learned languages all texts are `und`; one language alone has no bits and is always predicted, with score 1.
Languages are the distinct non-null values to learn from, 64-bit counts of BUCKETS numbers each on the driver. Very long texts are
read whole, piece by piece. Repeated rows, and rows of one id, are predicted each, equal texts equally; a null id stays null. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm.scratch import settle

UNKNOWN = "und"
GRAMS = 4
BUCKETS = 1 << 16  # a hash's upper half
#: Prior count of a bucket in the shares of a side.
SMOOTH = 0.5
MARGIN = 1.0
#: A bit's mean weight lies within REACH; a value's place among BINS.
REACH, BINS = 8.0, 512
_CHUNKS = 16
_PIECE = 1 << 18
SUMS = "lang string, chunk int, salt int, body binary"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """Code points of a text in lower case, each run of anything but letters as one 0; a 0 first and last. Without letters, empty."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(_letters()[a], a, 0)
    a = a[np.append(True, (a[1:] != 0) | (a[:-1] != 0))[: len(a)]]
    inner = a[(1 if len(a) and not a[0] else 0) : (-1 if len(a) > 1 and not a[-1] else None)]
    return np.concatenate(([0], inner, [0])).astype(np.uint32) if inner.any() else np.empty(0, np.uint32)


def grams(a: np.ndarray) -> np.ndarray:
    """Buckets of the sequences of 1 to GRAMS letters and word ends; no sequence goes over a word's end, and an end alone is none."""
    out, letter = [], a != 0
    name, inside = a, letter  # inside: nothing but a sequence's first and last place may be an end
    for k in range(1, GRAMS + 1):
        m = len(a) - k + 1
        if m <= 0:
            break
        if k > 1:
            name = name[:m] * np.uint32(0x9E3779B1) + a[k - 1 :]
            inside = letter[:m] | letter[1 : m + 1] if k == 2 else inside[:m] & letter[k - 2 : k - 2 + m]
        out.append(((name[inside] + np.uint32(k)) * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def pieces(text: bytes):
    """Letters of a text in parts of about _PIECE letters, cut at ends of words, so that every sequence is in one part."""
    a = letters_of(text.decode("utf-8", "replace"))
    ends = np.flatnonzero(a == 0)
    lo = 0
    while lo + 1 < len(a):
        hi = int(ends[min(np.searchsorted(ends, lo + _PIECE), len(ends) - 1)])
        yield a[lo : hi + 1]
        lo = hi


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _sum_up(sums: DataFrame) -> DataFrame:
    """Of rows of one language, chunk and salt, the sum."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(B.expand(x), np.int64) for x in table.column("body").to_pylist())
        row = {k: [table.column(k)[0].as_py()] for k in ("lang", "chunk", "salt")} | {"body": [B.squeeze(total.tobytes())]}
        return pa.table(row, schema=pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("salt", pa.int32()), ("body", pa.binary())]))

    return sums.groupBy("lang", "chunk", "salt").applyInArrow(run, SUMS)


def count_grams(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and counts [languages, BUCKETS]; rows: doc_id, text, lang.

    Each task gives its sums in chunks of buckets; 64 tasks' sums are added up first, then the sums of these.
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), B.texts_of(batch, "text"), strict=True):
                count = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a in pieces(text):
                    np.add.at(count, grams(a), 1)
        task = TaskContext.get()
        salt = task.partitionId() // 64 if task else 0
        for lang, count in total.items():
            parts = np.split(count, _CHUNKS)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * _CHUNKS, "chunk": pa.array(range(_CHUNKS), pa.int32()), "salt": pa.array([salt] * _CHUNKS, pa.int32()), "body": pa.array([B.squeeze(p.tobytes()) for p in parts], pa.binary())})

    sums = _sum_up(_sum_up(rows.mapInArrow(run, SUMS)).withColumn("salt", F.lit(0)))
    found = {(r.lang, r.chunk): np.frombuffer(B.expand(bytes(r.body)), np.int64) for r in sums.collect()}
    langs = sorted({lang for lang, _ in found})
    return langs, np.stack([np.concatenate([found[x, c] for c in range(_CHUNKS)]) for x in langs]) if langs else np.zeros((0, BUCKETS), np.int64)


def codewords(n: int, draws: int = 200) -> np.ndarray:
    """[n, bits] of 0 and 1: rows far apart, no column constant, none equal to another or to its opposite."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= 5:
        return np.array([(1, *x) for x in product((0, 1), repeat=n - 1) if not all(x)]).T
    bits, best, apart = 4 * int(np.ceil(np.log2(n))) + 3, None, -1
    random = np.random.Generator(np.random.PCG64(n))
    for _ in range(draws):
        if n <= 20:  # the splits are numbers, drawn without repeats
            code = random.choice(2 ** (n - 1) - 1, bits, replace=False)[None] >> np.arange(n - 1)[:, None] & 1
        else:
            code = random.integers(0, 2, (n - 1, bits))
            code[0, code.all(axis=0)] = 0
        code = np.concatenate((np.ones((1, bits), np.int64), code))  # a column and its opposite are one split
        distance = (code[:, None] != code[None]).sum(axis=2) + bits * np.eye(n, dtype=np.int64)
        if len(np.unique(code, axis=1).T) == bits and distance.min() > apart:
            best, apart = code, distance.min()
    if best is None:
        raise ValueError(f"no code for {n} languages in {draws} draws")
    return best


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """[bits, BUCKETS]: log ratios of a bucket's shares among the languages with a 1 and those with a 0, every language counting alike."""
    share = (counts + SMOOTH * counts.sum(axis=0, keepdims=True) / max(1, counts.sum()) + 1e-3) / np.maximum(1, counts.sum(axis=1, keepdims=True))
    one, none = code.T / np.maximum(1, code.sum(axis=0))[:, None], (1 - code).T / np.maximum(1, (1 - code).sum(axis=0))[:, None]
    return np.log((one @ share) / (none @ share)).astype(np.float32)


def mean_weights(text: bytes, weights: np.ndarray) -> np.ndarray | None:
    """Mean weight of a text's sequences for each bit, or None if it has no letter."""
    total, n = np.zeros(len(weights)), 0
    for a in pieces(text):
        at = grams(a)
        total += [np.take(w, at).sum() for w in weights]
        n += len(at)
    return np.clip(total / n, -REACH, REACH) if n else None


def fit_line(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float, float]:
    """Scale and bias of the log odds of a 1 at value x, and the share of the mass that these put on the right side."""
    w, n = np.array([1.0, 0.0]), ones + zeros
    d = np.stack((x, np.ones(len(x))))
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ d, -40, 40)))
        step = np.linalg.solve((d * (n * p * (1 - p))) @ d.T + ridge, d @ (n * p - ones) + ridge @ w)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    right = np.where(w @ d > 0, ones, zeros).sum() / max(1, n.sum())
    return float(w[0]), float(w[1]), float(right)


def decode(odds: np.ndarray, code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codeword of the least weighted loss, its share of exp(-loss), and whether another is within MARGIN."""
    loss = np.stack([(weights * np.logaddexp(0, np.where(word, -odds, odds))).sum(axis=1) for word in code], axis=1)
    best = loss.argmin(axis=1)
    rest = np.exp(loss.min(axis=1, keepdims=True) - loss)
    near = (loss <= loss.min(axis=1, keepdims=True) + MARGIN).sum(axis=1) > 1
    return best, 1 / rest.sum(axis=1), near


def measure(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, lang and `x`, the mean weight of each text for each bit (null without letters); rows: doc_id, text, lang."""

    def run(batches):
        for batch in batches:
            x = [mean_weights(t, weights) for t in B.texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "lang", "x"])

    return rows.mapInArrow(run, "doc_id long, lang string, x array<double>")


def _rows(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an x, and these rows' x."""
    x = batch.column("x")
    some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
    return some, x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(some), bits)


def calibrate(measured: DataFrame, langs: list[str], code: np.ndarray) -> np.ndarray:
    """Scale, bias and weight of each bit [3, bits], from the rows of measure() that have a language and letters."""
    bits = code.shape[1]
    if not bits:
        return np.zeros((3, 0))

    def run(batches):
        total = np.zeros((2, bits, BINS), np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            some, x = _rows(batch, bits)
            at = np.minimum(((x + REACH) * (BINS / (2 * REACH))).astype(np.int64), BINS - 1)
            side = code[[number[k] for k in batch.column("lang").take(pa.array(some)).to_pylist()]].reshape(len(some), bits)
            np.add.at(total, (side, np.broadcast_to(np.arange(bits), side.shape), at), 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "n": pa.array(total.ravel()[k], pa.int64())})

    spread = np.zeros(2 * bits * BINS)
    for r in measured.where("lang is not null").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        spread[r.k] = r.n
    zeros, ones = spread.reshape(2, bits, BINS)
    x = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    lines = np.array([fit_line(x, o, z) for o, z in zip(ones, zeros, strict=True)]).T
    lines[2] = np.maximum(0.05, 2 * lines[2] - 1)
    return lines


class LanguageModel:
    """Languages, codewords [languages, bits], weights [bits, BUCKETS], and scale, bias and weight of each bit [3, bits]."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, lines: np.ndarray):
        self.langs, self.code, self.weights, self.lines = langs, code, weights, lines

    def decide(self, measured: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score and ambiguous for the rows of measure()."""
        langs, code, lines = self.langs, self.code, self.lines

        def run(batches):
            for batch in batches:
                names, score, near = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                some, x = _rows(batch, code.shape[1])
                if langs and len(some):
                    best, score[some], near[some] = decode(x * lines[0] + lines[1], code, lines[2])
                    for i, k in zip(some.tolist(), best.tolist(), strict=True):
                        names[i] = langs[k]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

        return measured.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred, score and ambiguous for every text."""
        return self.decide(measure(B.document_rows(docs, id_col, text_col).withColumn("lang", F.lit(None).cast("string")), self.weights))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learned: Column | bool = True) -> tuple[LanguageModel, DataFrame]:
    """The model, and the settled measurements of every row for its decide(). Only rows of the condition `learned` whose text and
    language are not null are learned from; of the others no language is read."""
    lang = F.when(F.lit(True) if learned is True else learned, docs[lang_col].cast("string"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    langs, counts = count_grams(rows.where("text is not null and lang is not null"))
    code = codewords(len(langs))
    weights = bit_weights(counts, code) if langs else np.zeros((0, BUCKETS), np.float32)
    measured = settle(measure(rows, weights), "measured")
    return LanguageModel(langs, code, weights, calibrate(measured, langs, code)), measured


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, measured = learn(docs, learned=~held_out(F.col("doc_id")))
    return model.decide(measured).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
