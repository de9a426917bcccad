"""Hard-negative mining by product quantisation with stored residual norms.

Vectors become integers, floor(256 * x). Codebooks of CENTRES integer centres for every WIDTH components are fitted on at most
SAMPLE rows; each row is stored with the codes of its nearest centres and with the norms of what is left in each subspace. A table
of products of an anchor with all centres then gives a row's score up to a bound that holds for certain: by Cauchy-Schwarz the rest
is at most the sum over the subspaces of the anchor's norm times the row's residual norm (and a margin for rounding).

Anchors are a stated query set and meet all rows in blocks: every pair of a block of anchors and a block of rows is a piece of
work of its own. Twice: first for an anchor's positives, among the rows of its label, then for the negatives of each window that a
positive's score opens. In both a row is left out only if its bounds show that it lies outside the window, or that enough others
of the block come before it; all others get their exact integer product. Blocks give at most as many rows as are wanted, and the
best of these over all blocks are the result, so it is exact whatever the codebooks are: there is no cap on candidates.

Rows with a null label, no vector or a null or non-finite component take no part, nor do rows without an id, which could not be
named. Rows that share an id are one item, the one with the least label and vector. Vectors of unequal length are as if followed
by zeros. Components are held within 2 ** 27, which no float of a magnitude below half a million reaches. Ties go by id. An empty table, one
label alone or anchors without partners give no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm import blocks as B
from loomwright.llm.scratch import settle

SCALE = 256
WIDTH, CENTRES, SAMPLE, STEPS = 2, 256, 8_192, 6
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these parts of a positive's, in hundredths.
LOWEST, HIGHEST = 50, 95
#: Rows of a block (fewer only to occupy more tasks, and then at least LEAST_ROWS, since a block gives rows for each anchor),
#: anchors of a block, and the anchors that are scored at once.
ROWS, LEAST_ROWS, ANCHORS, AT_ONCE = 1 << 14, 1 << 10, 1 << 13, 64
_PAIRS = 1 << 15
_MOST = 1 << 27
PAIR_SCHEMA = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label and vec, the integers of each row that takes part; a row for each id."""
    real = rows[vector_col].cast("array<double>")
    sound = F.forall(real, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    whole = F.transform(real, lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(SCALE * x).cast("long"))).cast("int"))
    some = rows.select(rows[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), real.alias("real"), sound.alias("sound"), whole.alias("vec"))
    some = some.where("vec_id is not null and label is not null and real is not null and sound")
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec")


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point."""
    p, c = points.astype(np.float32), centres.astype(np.float32)
    return ((c**2).sum(axis=1)[None] - 2 * p @ c.T).argmin(axis=1)


def fit_codebooks(sample: np.ndarray) -> np.ndarray:
    """[subspaces, CENTRES, WIDTH] integers from rows whose length is a multiple of WIDTH."""
    n, d = sample.shape
    out = np.zeros((d // WIDTH, CENTRES, WIDTH), np.int64)
    for j in range(d // WIDTH):
        points = sample[:, j * WIDTH : (j + 1) * WIDTH].astype(np.float64)
        some = np.unique(points, axis=0) if n else np.zeros((1, WIDTH))
        centres = np.random.Generator(np.random.PCG64(j)).permutation(some)[:CENTRES]
        centres = np.concatenate((centres, np.repeat(centres[:1], CENTRES - len(centres), axis=0)))
        for _ in range(STEPS if len(some) > CENTRES else 0):
            at = nearest(points, centres)
            size = np.bincount(at, minlength=CENTRES)
            means = np.stack([np.bincount(at, weights=points[:, k], minlength=CENTRES) for k in range(WIDTH)], axis=1) / np.maximum(1, size)[:, None]
            centres = np.where(size[:, None] > 0, means, centres)
        out[j] = np.rint(centres)
    return out


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes [rows, subspaces], residual norms of the same shape rounded upwards, and the norm of each row's centres."""
    codes = np.zeros((len(x), len(books)), np.uint8)
    norms = np.zeros(codes.shape, np.float32)
    centre = np.zeros(len(x))
    for j, book in enumerate(books):
        part = x[:, j * WIDTH : (j + 1) * WIDTH].astype(np.int64)
        codes[:, j] = at = nearest(part, book)
        norms[:, j] = np.sqrt(((part - book[at]).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
        centre += (book[at].astype(np.float64) ** 2).sum(axis=1)
    return codes, norms, np.sqrt(centre)


class Rows:
    """A block of rows: ids, labels, vectors, codes, residual norms and norms of centres."""

    TYPES = (np.int64, np.int64, np.int32, np.uint8, np.float32, np.float64)

    def __init__(self, data: bytes, d: int):
        self.ids, self.labels, vec, codes, norms, self.centre = B.unpack(B.expand(data), *self.TYPES)
        n = len(self.ids)
        self.vec, self.codes, self.norms = vec.reshape(n, d), codes.reshape(n, d // WIDTH), norms.reshape(n, d // WIDTH)

    @classmethod
    def pack(cls, ids, labels, vec, books) -> bytes:
        return B.squeeze(B.pack(*[a.astype(t) for a, t in zip((ids, labels, vec, *encode(vec, books)), cls.TYPES, strict=True)]))

    def bounds(self, anchors: np.ndarray, books: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product [rows, anchors] that the codes and norms of some rows allow."""
        codes, parts = self.codes[at], anchors.reshape(len(anchors), len(books), WIDTH).astype(np.float64)
        total = np.zeros((len(codes), len(anchors)), np.float32)
        got = np.empty_like(total)
        for j, book in enumerate(books):
            np.take((book @ parts[:, j].T).astype(np.float32), codes[:, j], axis=0, out=got)
            total += got
        size = np.sqrt((parts**2).sum(axis=2))
        slack = 1e-5 * (self.centre[at][:, None] * np.sqrt((size**2).sum(axis=1))[None] + 1)
        rest = (self.norms[at] @ (size.T * (1 + 1e-5)).astype(np.float32)) * np.float32(1 + 1e-5) + slack.astype(np.float32)
        return total - rest, total + rest


def products(rows: np.ndarray, anchors: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (row i, anchor k)."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), _PAIRS):
        x, y = i[lo : lo + _PAIRS], k[lo : lo + _PAIRS]
        out[lo : lo + _PAIRS] = np.einsum("ij,ij->i", rows[x].astype(np.int64), anchors[y].astype(np.int64))
    return out


def _rank(group: np.ndarray) -> np.ndarray:
    """Number of each item within its run of equal groups."""
    at = np.arange(len(group))
    fresh = np.append(True, group[1:] != group[:-1])[: len(group)]
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def positives_in(rows: Rows, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray, books: np.ndarray, most: int) -> list[np.ndarray]:
    """Columns anchor number, row id, product: the first rows of each anchor's label in this block, the anchor itself left out."""
    found = []
    order = np.argsort(labels, kind="stable")
    for label in np.unique(labels):
        at = np.flatnonzero(rows.labels == label)
        mine = order[slice(*np.searchsorted(labels[order], [label, label + 1]))]
        for lo in range(0, len(mine) if len(at) else 0, AT_ONCE):
            k = mine[lo : lo + AT_ONCE]
            low, high = rows.bounds(vec[k], books, at)
            self_ = rows.ids[at][:, None] == ids[k][None]
            low[self_] = high[self_] = -np.inf
            least = np.partition(low, len(at) - most, axis=0)[len(at) - most] if len(at) > most else np.full(len(k), -np.inf, np.float32)
            i, a = np.nonzero((high >= least) & ~self_)
            score = products(rows.vec, vec, at[i], k[a])
            by = np.lexsort((rows.ids[at[i]], -score, a))
            by = by[_rank(a[by]) < most]
            found.append(np.stack((k[a[by]], rows.ids[at[i[by]]], score[by])))
    return list(np.concatenate(found, axis=1)) if found else [np.empty(0, np.int64)] * 3


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of a negative, for products of positives."""
    return -(-(positive * LOWEST) // 100), positive * HIGHEST // 100


def negatives_in(rows: Rows, labels: np.ndarray, vec: np.ndarray, least: np.ndarray, largest: np.ndarray, books: np.ndarray, most: int) -> list[np.ndarray]:
    """Columns anchor number, window, row id, product: the first rows of another label in each of an anchor's windows.

    least, largest: [anchors, windows]; a window whose least is above its largest is none.
    """
    found = []
    for lo in range(0, len(vec), AT_ONCE):
        k = slice(lo, lo + AT_ONCE)
        low, high = rows.bounds(vec[k], books, slice(None))
        open_ = least[k] <= largest[k]
        down = np.where(open_, least[k], np.iinfo(np.int64).max).min(axis=1).astype(np.float32)
        up = np.where(open_, largest[k], np.iinfo(np.int64).min).max(axis=1).astype(np.float32)
        may = (high >= np.nextafter(down, np.float32(-np.inf))) & (low <= np.nextafter(up, np.float32(np.inf))) & (rows.labels[:, None] != labels[k][None])
        i, a = np.nonzero(may)
        low, high = low[i, a], high[i, a]
        by = np.lexsort((-low, a))
        i, a, low, high = i[by], a[by], low[by].astype(np.float64), high[by].astype(np.float64)
        wanted = np.zeros(len(i), bool)
        for w in range(least.shape[1]):
            x, y = least[k][a, w], largest[k][a, w]
            possible = (high >= x) & (low <= y) & (x <= y)
            sure = np.flatnonzero(possible & (low >= x) & (high <= y))
            last = sure[_rank(a[sure]) == most - 1]
            enough = np.full(len(open_), -np.inf)
            enough[a[last]] = low[last]
            wanted |= possible & (high >= enough[a])
        i, a = i[wanted], a[wanted] + lo
        score = products(rows.vec, vec, i, a)
        by = np.lexsort((rows.ids[i], -score, a))
        i, a, score = i[by], a[by], score[by]
        for w in range(least.shape[1]):
            inside = np.flatnonzero((score >= least[a, w]) & (score <= largest[a, w]))
            inside = inside[_rank(a[inside]) < most]
            found.append(np.stack((a[inside], np.full(len(inside), w), rows.ids[i[inside]], score[inside])))
    return list(np.concatenate(found, axis=1)) if found else [np.empty(0, np.int64)] * 4


def _matrix(lists: pa.ChunkedArray, d: int) -> np.ndarray:
    """Lists of integers as rows of length d, the rest zeros."""
    sizes = np.array(lists.combine_chunks().value_lengths().to_pylist(), np.int64)
    out = np.zeros((len(sizes), d), np.int32)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.combine_chunks().flatten().to_numpy()
    return out


def _spread(blocks: DataFrame, to: str, n: int) -> DataFrame:
    return blocks.withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchors: Column | str = "vec_id % 50 = 0",
    positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE, block_rows: int = ROWS, block_anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor, its first `positives` other rows of the same label, and for each of these the first `negatives` rows of
    other labels whose score lies in the positive's window; higher scores come first, then smaller ids. anchors: a condition on
    vec_id and label.
    """
    spark = rows.sparkSession
    items = settle(vectors(rows, id_col, vector_col, rows["label"] if label is None else label), "vectors")
    known = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).first()
    d = -(-known.d // WIDTH) * WIDTH
    fitted = items.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    books = fit_codebooks(_matrix(fitted.column("vec"), d))
    n_rows = max(1, -(-known.n // block_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.n // min(block_rows, LEAST_ROWS))))

    def to_rows(table: pa.Table) -> pa.Table:
        payload = Rows.pack(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vec"), d), books)
        return pa.table({"h": pa.array([table.column("h")[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    row_blocks = settle(items.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).groupBy("h").applyInArrow(to_rows, "h int, payload binary"), "row-blocks")
    queries = items.where(anchors)
    n_anchors = max(1, -(-queries.count() // block_anchors))
    queries = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n_anchors)).cast("int"))

    def to_anchors(table: pa.Table) -> pa.Table:
        payload = B.squeeze(B.pack(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vec"), d)))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    def pairs(payload_of_row: pa.Table, payload_of_anchor: pa.Table, *types):
        """The block of rows and the arrays of the block of anchors, or nothing where either is absent."""
        if not (payload_of_row.num_rows and payload_of_anchor.num_rows):
            return None
        return Rows(payload_of_row.column("payload")[0].as_py(), d), B.unpack(B.expand(payload_of_anchor.column("payload")[0].as_py()), *types)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        k = ids = score = anchor = np.empty(0, np.int64)
        if got := pairs(left, right, np.int64, np.int64, np.int32):
            block, (anchor, labels, vec) = got
            k, ids, score = positives_in(block, anchor, labels, vec.reshape(len(anchor), d), books, positives)
        return pa.table({"anchor_id": anchor[k], "positive_id": ids, "positive_score": score})

    spread = _spread(row_blocks, "g", n_anchors).groupBy("g", "h")
    asked = _spread(queries.groupBy("g").applyInArrow(to_anchors, "g int, payload binary"), "h", n_rows).groupBy("g", "h")
    near = spread.cogroup(asked).applyInArrow(first, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = settle(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    lists = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen"))
    armed = queries.join(lists, F.col("vec_id") == F.col("anchor_id")).select("g", "vec_id", "label", "vec", "chosen.positive_id", "chosen.positive_score")

    def to_windows(table: pa.Table) -> pa.Table:
        n, names, score = table.num_rows, table.column("positive_id").to_pylist(), table.column("positive_score").to_pylist()
        size = np.array([len(x) for x in names], np.int64)
        held = np.zeros((2, n, positives), np.int64)
        for k, (x, y) in enumerate(zip(names, score, strict=True)):
            held[0, k, : len(x)], held[1, k, : len(y)] = x, y
        payload = B.squeeze(B.pack(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vec"), d), size, held))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        a = w = ids = score = anchor = np.empty(0, np.int64)
        held = np.zeros((2, 0, positives), np.int64)
        if got := pairs(left, right, np.int64, np.int64, np.int32, np.int64, np.int64):
            block, (anchor, labels, vec, size, held) = got
            held = held.reshape(2, len(anchor), positives)
            least, largest = window(held[1])
            least = np.where(np.arange(positives)[None] < size[:, None], least, largest + 1)
            a, w, ids, score = negatives_in(block, labels, vec.reshape(len(anchor), d), least, largest, books, negatives)
        return pa.table({"anchor_id": anchor[a], "positive_id": held[0, a, w], "positive_score": held[1, a, w], "negative_id": ids, "negative_score": score})

    asked = _spread(armed.groupBy("g").applyInArrow(to_windows, "g int, payload binary"), "h", n_rows).groupBy("g", "h")
    hard = spread.cogroup(asked).applyInArrow(second, PAIR_SCHEMA)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, label=label)


OP12_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e AS a, e AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
