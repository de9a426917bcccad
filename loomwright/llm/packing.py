"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every window each queue that still has tokens gets a quantum in proportion
to its target share; what a quantum leaves over as a fraction of a token is its deficit and counts in the next window. The
number of tokens that a queue has given after w windows is then a whole-number formula of w (Schedule.given), so deficits pass
over windows and partitions with no state: a block needs only how many tokens of each queue lie in the blocks before it. These
are sums in two levels, over the blocks of an input partition and over the partitions, so no task sees all blocks of a source.
The windows, one after the other, form one stream that is cut every `length` tokens. A document is cut where its window or its
sequence ends. Only the last sequence can be short; it is padded to `length`, unless it ends at a power of two.

There is a queue for each source, however many; the driver and every task hold a few numbers for each (about 100 bytes).

Ids are those of the tokenizer file, which takes its added tokens (such as an end-of-text mark) out of a text first; with
added_tokens=False their strings are ordinary text. Null and empty texts are one token, the separator. A null source is a
source of its own. Texts and words of any length are read whole. Repeated rows and rows of one id are packed each, a null id
stays null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm import blocks as B
from loomwright.llm import tokens as T
from loomwright.llm.scratch import settle

LENGTH = 1024
WINDOW_SEQUENCES = 64
END = 0
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, padded_length long, ids binary"


def _share(n: int, part: np.ndarray, whole: int) -> np.ndarray:
    """floor(n * part / whole) of 0 <= part <= whole < 2 ** 46, by long division in steps of 16 bits."""
    out, rest = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for shift in range(48, -1, -16):
        value = (rest << 16) + part * (n >> shift & 0xFFFF)
        out = (out << 16) + value // whole
        rest = value % whole
    return out


class Schedule:
    """How many tokens each queue has given after any number of windows.

    totals: tokens in each queue; weights: target shares (the queues' own sizes if none are given). Phases last while the same
    queues have tokens; within a phase a queue's total after w windows is floor(begin + (w - w0) * window * weight / weights).
    Queues with no target come last, in proportion to their sizes. With the queues' own sizes there is one phase, with given
    weights one for each that ends, and two numbers a queue for each.
    """

    def __init__(self, totals: list[int], weights: list[int] | None, window: int):
        self.totals, self.window = np.array(totals, np.int64), window
        self.begin: list[tuple[int, np.ndarray, np.ndarray, int]] = []  # first window, given before it, weights, their sum
        share = np.array(totals if weights is None else weights, np.int64)
        given, w = np.zeros(len(totals), np.int64), 0
        while (given < self.totals).any():
            live = np.where(given < self.totals, share, 0)
            if not live.sum():  # only queues with no target are left
                live = self.totals - given
            whole = int(live.sum())
            if whole >= 1 << 46:
                raise ValueError("weights must sum to less than 2 ** 46")
            self.begin.append((w, given, live, whole))
            some = np.flatnonzero(live)
            lasts = min(-(-(t - g) * whole // (x * window)) for x, g, t in zip(live[some].tolist(), given[some].tolist(), self.totals[some].tolist(), strict=True))
            given = np.minimum(self.totals, given + _share(lasts * window, live, whole))
            w += lasts
        self.windows = w
        self.firsts = [b[0] for b in self.begin]

    def given(self, w: int) -> np.ndarray:
        if not self.begin or w <= 0:
            return np.zeros(len(self.totals), np.int64)
        w0, before, live, whole = self.begin[bisect_right(self.firsts, w - 1) - 1]
        return np.minimum(self.totals, before + _share((w - w0) * self.window, live, whole))

    def given_of(self, queue: int, w: int) -> int:
        w0, before, live, whole = self.begin[bisect_right(self.firsts, w - 1) - 1]
        return min(int(self.totals[queue]), int(before[queue]) + (w - w0) * self.window * int(live[queue]) // whole)

    def window_of(self, queue: int, x: int) -> int:
        """The window that has token x of a queue."""
        phase = bisect_right(self.begin, x, key=lambda b: int(b[1][queue])) - 1
        w0, before, live, whole = self.begin[phase]
        lo = w0
        if live[queue]:  # the formula's inverse, then a step or two for its rounding
            lo = max(lo, w0 + (x - int(before[queue])) * whole // (int(live[queue]) * self.window) - 1)
        while lo < self.windows and self.given_of(queue, lo + 1) <= x:
            lo += 1
        return lo


def _tokenize(docs: DataFrame, id_col, text_col, source_col, tokenizer_file, added_tokens, block_bytes) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"))

    def run(batches):
        cache = T.WordIds(T.json_encoder(tokenizer_file, public_tokenizers.PATTERN).encode_ordinary)
        added = T.added_tokens(tokenizer_file) if added_tokens else ()
        for block, kept in B.grouped(batches, block_bytes, "source"):
            parts, between, pieces = [], [], []
            for k, row in enumerate(kept):
                mine, marks = T.split_added(T.valid(row[1]), added)
                between += [(len(parts) + i, x, k) for i, x in enumerate(marks)]
                parts += mine
                pieces.append(len(mine))
            lens = np.array([len(x) for x in parts], np.int64)
            text = b"".join(parts)
            starts, names, first, which = T.distinct_words(text, lens)
            flat, counts = cache.look_up(text, starts, names, first)
            ids = T.take_lists(flat, counts, which)
            upto = np.concatenate(([0], np.cumsum(counts[which]))) if len(which) else np.zeros(1, np.int64)
            ends = upto[np.searchsorted(starts, np.cumsum(lens))]  # of the pieces, in ids
            n = np.diff(ends[np.cumsum(pieces) - 1], prepend=0)
            if between:
                at, marks, owner = (np.array(x) for x in zip(*between, strict=True))
                ids = np.insert(ids, ends[at], marks.astype(np.uint32))
                n = n + np.bincount(owner, minlength=len(kept))
            totals: dict[str | None, int] = {}
            for row, k in zip(kept, n.tolist(), strict=True):
                totals[row[2]] = totals.get(row[2], 0) + k + 1
            number = {s: i for i, s in enumerate(totals)}
            told = [b"" if s is None else s.encode("utf-8", "surrogatepass") for s in totals]
            sizes = np.array([-1 if s is None else len(x) for s, x in zip(totals, told, strict=True)], np.int32)
            planes = [(ids >> shift & 0xFF).astype(np.uint8) for shift in (0, 8, 16, 24)]
            payload = B.squeeze(B.pack(B.id_array(kept), n.astype(np.int64), np.array([number[row[2]] for row in kept], np.int32), sizes, b"".join(told), *planes))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": pa.array([payload], pa.binary()), "totals": pa.array([[{"source": s, "tokens": k} for s, k in totals.items()]], pa.list_(pa.struct([("source", pa.string()), ("tokens", pa.int64())])))})

    return rows.mapInArrow(run, "block long, payload binary, totals array<struct<source:string,tokens:long>>")


def _bases(per_block: DataFrame) -> DataFrame:
    """(block, bases): for each source of a block the tokens that it has in the blocks before; per_block: block, source, tokens."""
    part = per_block.withColumn("part", F.shiftright("block", 24))  # blocks number the input partition in their high bits
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = part.groupBy("source", "part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.col("source").alias("of"), earlier(Window.partitionBy("source").orderBy("part")).alias("base"))
    within = part.withColumn("within", earlier(Window.partitionBy("source", "part").orderBy("block")))
    both = within.alias("w").join(parts.alias("p"), (F.col("w.part") == F.col("p.part")) & F.col("w.source").eqNullSafe(F.col("p.of")))
    return both.groupBy("block").agg(F.collect_list(F.struct("source", (F.col("base") + F.col("within")).alias("base"))).alias("bases"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, weights: dict[str | None, int] | None = None, window_sequences: int = WINDOW_SEQUENCES, tokenizer_file: str | None = None, added_tokens: bool = True, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per piece of a document: where it starts in the document's ids, its ids (little-endian unsigned 32 bits) and their CRC-32, and its place."""
    tokenizer_file = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    blocks = settle(_tokenize(docs, id_col, text_col, source_col, tokenizer_file, added_tokens, block_bytes), "tokens")
    per_block = blocks.select("block", F.explode("totals").alias("t")).select("block", F.col("t.source").alias("source"), F.col("t.tokens").alias("tokens"))
    sums = {r.source: r.tokens for r in per_block.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    queues = {s: i for i, s in enumerate(names)}
    schedule = Schedule([sums[s] for s in names], None if weights is None else [weights.get(s, 0) for s in names], length * window_sequences)
    end = sum(sums.values())
    most = max(4, 4_000_000 // max(1, len(queues)))  # windows held at once, a few numbers a queue each

    def cut(batches):
        cache: dict[int, tuple] = {}

        def window(w):
            """What each queue has given before and after a window, and where its tokens begin in the stream."""
            if w not in cache:
                if len(cache) >= most:
                    cache.clear()
                have, then = schedule.given(w), schedule.given(w + 1)
                cache[w] = have, then, have.sum() + np.cumsum(then - have) - (then - have)
            return cache[w]

        for batch in batches:
            for payload, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, n_tokens, numbers, sizes, told, *planes = B.unpack(B.expand(payload.as_py()), np.int64, np.int64, np.int32, np.int32, bytes, *[np.uint8] * 4)
                ids = sum(x.astype(np.uint32) << np.uint32(s) for x, s in zip(planes, (0, 8, 16, 24), strict=True))
                ends = np.cumsum(np.maximum(sizes, 0)).tolist()
                sources = [None if k < 0 else told[e - k : e].decode("utf-8", "surrogatepass") for k, e in zip(sizes.tolist(), ends, strict=True)]
                at_of = {x["source"]: x["base"] for x in base}
                out: list[tuple] = []
                where = 0
                for doc, n, number in zip(doc_ids.tolist(), n_tokens.tolist(), numbers.tolist(), strict=True):
                    source = sources[number]
                    q = queues[source]
                    mine = np.append(ids[where : where + n], np.uint32(END))
                    where += n
                    x, done, total = at_of[source], 0, n + 1
                    at_of[source] = x + total
                    w = schedule.window_of(q, x)
                    while done < total:
                        have, then, stream = window(w)
                        if then[q] <= x:
                            w += 1
                            continue
                        g = int(stream[q] + x - have[q])
                        k = min(total - done, int(then[q]) - x)
                        while k:
                            m = min(k, length - g % length)
                            piece = mine[done : done + m].tobytes()
                            last = g // length == (end - 1) // length
                            used = (end - 1) % length + 1
                            padded = used if last and used & (used - 1) == 0 else length
                            out.append((None if doc == B.NO_ID else doc, done, m, zlib.crc32(piece), total, g // length, g % length, source, padded, piece))
                            done, x, g, k = done + m, x + m, g + m, k - m
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                columns = list(zip(*out, strict=True)) if out else [()] * 10
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.string()), pa.array(columns[8], pa.int64()), pa.array(columns[9], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "source", "padded_length", "ids"])

    return blocks.select("block", "payload").join(_bases(per_block), "block").select("payload", "bases").mapInArrow(cut, RESULT)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
