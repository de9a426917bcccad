"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts; all documents are the unlabelled web text. A linear score over measurements of the
whole text minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss. The measurements are of a text's form and of its words: words and word pairs fall into WORD_BUCKETS
buckets by hash, a first pass over all documents counts in how many texts, and in how many positives, each bucket occurs, and a
text is measured by the log ratios of its buckets, as counted in all other texts.

Sums of loss, gradients and curvature over every document, and over the positives among them, are gathered by Spark in one job,
a thousand numbers an iteration; each iteration is one Newton step. Where the bracket falls below zero, the step goes up the
bracket's own gradient instead; the weights with the least risk are kept. The class prior is estimated from positives and
unlabelled texts alone: a score is fitted to tell these two apart, and the prior is the least ratio of the shares that they have
above a threshold (where there are nearly no negatives left, unlabelled texts are positives diluted by the prior).

At most MOST_POSITIVES positives are learned from, so that their ids fit a task. Null and empty texts have all-zero measurements
and get a score like any other; a null id stays null and is no positive. Repeated rows, and rows of one id, are scored each, equal
texts with equal scores. Texts of any length are measured whole. An empty table gives no rows; without positives all scores are
0.5. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K
from loomwright.llm.scratch import settle

FEATURES = ("one", "words", "word_bytes", "symbols", "punctuation", "digits", "capitals", "lines", "bare", "again", "top", "repeat_three", "repeat_lines", "wide", "long_words", "bars")
WORD_FEATURES = ("odds_mean", "odds_high", "odds_low")
WORD_BUCKETS = 1 << 16
MOST_POSITIVES = 100_000
RIDGE = 1e-4
STEPS = 14

_CLASS = np.zeros(256, np.uint8)  # 1 sign, 2 punctuation, 3 digit, 4 capital, 5 bar, 6 beyond ASCII
for _kind, _bytes in enumerate((b"#*$%&<>=+^~@_{}[]\\/", b".,;:!?'\"()-", b"0123456789", bytes(range(65, 91)), b"|", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _kind


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    lens = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    a = np.frombuffer(whole, np.uint8)
    cuts = np.concatenate(([0], np.cumsum(lens)))
    starts, ends = K.words(a, cuts[1:])
    names = K.word_names(a, starts, ends)
    kind = _CLASS[a]
    per_kind = np.stack([np.diff(np.concatenate(([0], np.cumsum(kind == k)))[cuts]) for k in range(1, 7)], axis=1)
    plain = np.concatenate(([0], np.cumsum((kind == 0) | (kind == 3) | (kind == 4) | (kind == 6))))
    bare = np.concatenate(([0], np.cumsum(plain[ends] == plain[starts])))
    long_ = np.concatenate(([0], np.cumsum(ends - starts > 20)))
    at = np.searchsorted(starts, cuts)
    three = K.rolling(names, 3)
    out = np.zeros((len(texts), len(FEATURES)))
    for d, text in enumerate(texts):
        i, j = int(at[d]), int(at[d + 1])
        n = j - i
        out[d, 0] = 1
        if not n:
            continue
        mine = np.sort(names[i:j])
        fresh = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        top = int(np.diff(np.append(fresh, n)).max())
        repeats = 0.0
        if n >= 3:
            t = three[i : j - 2]
            uniq, which, times = np.unique(t, return_inverse=True, return_counts=True)
            if len(uniq) < len(t):
                hit = np.zeros(n, bool)
                k = np.flatnonzero(times[which] > 1)
                hit[k] = hit[k + 1] = hit[k + 2] = True
                repeats = hit.mean()
        lines = Counter(x for x in text.split(b"\n") if x.strip())
        n_lines = sum(lines.values())
        signs, points, digits, capitals, bars, wide = per_kind[d].tolist()
        size = max(1, int(lens[d]))
        out[d, 1:] = (
            np.log1p(n) / 5, (ends[j - 1] - starts[i] - n + 1) / n / 8, min(3, 10 * signs / n) / 3, min(1, points / n), min(1, digits / n), min(1, capitals / n), min(1, 5 * n_lines / n), (bare[j] - bare[i]) / n,
            (1 - len(fresh) / n) ** 2, min(1, top / n), repeats, 1 - len(lines) / max(1, n_lines), wide / size, (long_[j] - long_[i]) / n, min(1, 5 * bars / n),
        )
    return out


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), sorted: the distinct buckets that words and word pairs of each text fall in."""
    cuts = np.cumsum(np.array([len(t) for t in texts], np.int64))
    a = np.frombuffer(b"".join(texts).lower(), np.uint8)
    starts, ends = K.words(a, cuts)
    names = K.word_names(a, starts, ends)
    doc = np.searchsorted(cuts, starts, side="right")
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    both = np.concatenate((doc * WORD_BUCKETS + (K.mix(names) % np.uint64(WORD_BUCKETS)).astype(np.int64), doc[pairs] * WORD_BUCKETS + (K.rolling(names, 2)[pairs] % np.uint64(WORD_BUCKETS)).astype(np.int64) if len(pairs) else []))
    found = np.unique(both.astype(np.int64))
    return found // WORD_BUCKETS, found % WORD_BUCKETS


def _is_positive(rows, positives: np.ndarray) -> np.ndarray:
    return np.isin(B.id_array(rows), positives)


def count_buckets(rows: DataFrame, positives: np.ndarray) -> np.ndarray:
    """[2, WORD_BUCKETS + 1]: in how many texts, and in how many positives, each bucket occurs; last the numbers of texts."""

    def run(batches):
        total = np.zeros((2, WORD_BUCKETS + 1), np.int64)
        for _, some in B.grouped(batches, B.BLOCK_BYTES // 2):
            doc, bucket = word_buckets([r[1] for r in some])
            good = _is_positive(some, positives)
            total[0] += np.bincount(bucket, minlength=WORD_BUCKETS + 1)
            total[1] += np.bincount(bucket[good[doc]], minlength=WORD_BUCKETS + 1)
            total[:, -1] += len(some), good.sum()
        k = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "u": pa.array(total[0, k]), "p": pa.array(total[1, k])})

    out = np.zeros((2, WORD_BUCKETS + 1), np.int64)
    for r in rows.mapInArrow(run, "k int, u long, p long").groupBy("k").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():
        out[:, r.k] = r.u, r.p
    return out


def _log_odds(u, p, n_u, n_p):
    """How much more often positives have a bucket than all texts do, as a log ratio of counts; rare buckets tell little."""
    return np.log((p + 1.0) / (n_p * u / np.maximum(1, n_u) + 1.0))


def measure_words(texts: list[bytes], good: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of WORD_FEATURES for each text."""
    doc, bucket = word_buckets(texts)
    own = good[doc].astype(np.int64)
    odds = _log_odds(counts[0, bucket] - 1, counts[1, bucket] - own, counts[0, -1] - 1, counts[1, -1] - own)
    n = np.maximum(1, np.bincount(doc, minlength=len(texts)))
    return np.stack([np.bincount(doc, weights=x, minlength=len(texts)) / n for x in (odds, odds > 0.5, odds < -0.5)], axis=1)


def features(docs: DataFrame, positives: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, good (among the positives, a sorted array of ids) and `x`, the measurements of each whole text."""
    documents = B.document_rows(docs, id_col, text_col)
    counts = count_buckets(documents, positives)

    def run(batches):
        for _, rows in B.grouped(batches, B.BLOCK_BYTES // 2):
            good, texts = _is_positive(rows, positives), [r[1] for r in rows]
            x = np.hstack((measure(texts), measure_words(texts, good, counts)))
            offsets = pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "good": pa.array(good), "x": pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))})

    return documents.mapInArrow(run, "doc_id long, good boolean, x array<double>")


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sums:
    """Over some rows: their number, sum of x, and sums of loss(-), its gradient and its curvature."""

    def __init__(self, v: np.ndarray, d: int):
        self.n, self.loss = v[0], v[1]
        self.x, self.slope, self.bend = v[2 : 2 + d], v[2 + d : 2 + 2 * d], v[2 + 2 * d :].reshape(d, d)


def sums_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The numbers of Sums for rows x."""
    z = np.clip(x @ w, -40, 40)
    p = _sigmoid(z)
    return np.concatenate(([len(x), np.logaddexp(0, z).sum()], x.sum(axis=0), x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()))


def _sums(rows: DataFrame, w: np.ndarray) -> tuple[Sums, Sums]:
    """Of all rows (good, x) and of the good ones, in one job."""
    d = len(w)
    size = 2 + 2 * d + d * d

    def run(batches):
        total = np.zeros(2 * size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, d)
                total += np.concatenate((sums_of(x, w), sums_of(x[batch.column("good").to_numpy(zero_copy_only=False)], w)))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(2 * size), pa.int32()), "v": pa.array(total)})

    v = np.zeros(2 * size)
    for r in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        v[r.k] = r.v
    return Sums(v[:size], d), Sums(v[size:], d)


def newton(gather, d: int, prior: float | None, steps: int = STEPS) -> np.ndarray:
    """Weights; gather(w) gives the Sums of unlabelled rows and of positives. Without a prior, both are told apart, each as half."""
    w, best, least = np.zeros(d), np.zeros(d), np.inf
    ridge = RIDGE * np.eye(d)
    ridge[0, 0] = 0
    for _ in range(steps):
        u, p = gather(w)
        if not u.n or not p.n:
            return best
        plus = (p.loss - p.x @ w) / p.n  # loss(+) - loss(-) is linear
        if prior is None:
            value = plus + u.loss / u.n
            slope, bend = u.slope / u.n + (p.slope - p.x) / p.n, u.bend / u.n + p.bend / p.n
            bracket = 1.0
        else:
            bracket = u.loss / u.n - prior * p.loss / p.n
            value = prior * plus + max(0.0, bracket)
            slope, bend = u.slope / u.n - prior * p.x / p.n, u.bend / u.n
        value += 0.5 * w @ ridge @ w
        if value < least:
            best, least = w, value
        if bracket < 0:  # the empirical risk of negatives cannot be: undo some of the fit to them
            w = w + 0.5 * (u.slope / u.n - prior * p.slope / p.n)
            continue
        step = np.linalg.solve(bend + ridge + 1e-9 * np.eye(d), slope + ridge @ w)
        step *= min(1.0, 6.0 / max(1e-9, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return best


def fit(rows: DataFrame, prior: float | None, steps: int = STEPS) -> np.ndarray:
    """Weights of the score x @ w; rows: good, x."""
    return newton(lambda w: _sums(rows, w), len(FEATURES) + len(WORD_FEATURES), prior, steps)


def least_ratio(unlabelled: np.ndarray, good: np.ndarray) -> float:
    """The class prior from counts by ascending score: the least ratio of the shares above a threshold, each with its margin."""
    n_u, n_p = max(1, unlabelled.sum()), max(1, good.sum())
    above_u, above_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(good[::-1]) / n_p
    margin = np.sqrt(np.log(40) / 2 / n_u) + np.sqrt(np.log(40) / 2 / n_p)
    some = above_p > min(0.5, 5 * margin)
    at = int(np.argmin(np.where(some, (above_u + margin) / np.maximum(above_p, 1e-9), np.inf)))
    return float(min(0.99, max(0.01, above_u[at] / max(above_p[at], 1e-9))))


def estimate_prior(rows: DataFrame) -> float:
    """The share of positives in the unlabelled rows; rows: good, x."""
    scored = score(rows, fit(rows, None, 8)).select("good", F.floor(F.col("score") * 999).cast("int").alias("bin"))
    counts = np.zeros((2, 1000))
    for r in scored.groupBy("bin").agg(F.count("*").alias("u"), F.count_if("good").alias("p")).collect():
        counts[:, r.bin] = r.u, r.p
    return least_ratio(*counts)


def score(rows: DataFrame, w: np.ndarray) -> DataFrame:
    total = F.lit(0.0)
    for i, x in enumerate(w.tolist()):
        total = total + F.col("x")[i] * F.lit(x)
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total)))))


def held_out(doc_id, folds: int, fold: int):
    return F.crc32(doc_id.cast("string")) % folds == fold


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_POSITIVES) -> tuple[DataFrame, np.ndarray, float]:
    """Measured rows, weights and the estimated prior; labels: doc_id of trusted positives."""
    chosen = labels.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    rows = settle(features(docs, np.sort(np.array([r.doc_id for r in chosen], np.int64)), id_col, text_col), "features")
    prior = estimate_prior(rows)
    return rows, fit(rows, prior), prior


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 3, 1) & (F.col("quality") == 1))
    rows, w, _ = model(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.select("doc_id"))
    return score(rows, w).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
