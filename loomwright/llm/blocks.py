"""Blocks of whole documents, and requests that blocks send to hash buckets.

A block holds some whole documents (about BLOCK_BYTES of text, or one longer document), sorted by id. Operators that look
for repeated strings send each of a block's distinct keys once to the bucket that the key hashes to, so a key that a third of
all documents hold costs a bucket one entry a block. Buckets answer by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Stands for a null id within a block; so a null id counts as the least.
NO_ID = -(1 << 63)
BLOCK_SCHEMA = "block long, payload binary, size long"
MESSAGE_SCHEMA = "bucket int, block long, body binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings and arrays as one byte string; unpack() needs their types."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes, *types) -> list:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        part = data[at : at + size]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += size
    return out


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under names that no other column of docs can clash with."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def id_array(rows) -> np.ndarray:
    """The ids of rows whose first item is one."""
    return np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    """Ids as they were given, nulls included."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def grouped(batches: Iterator[pa.RecordBatch], block_bytes: int, extra: str | None = None):
    """(block id, rows) in the order of the rows; a row is (doc id, text bytes) or has the extra column too."""
    task, seq, rows, size = TaskContext.get(), 0, [], 0
    base = (task.partitionId() if task else 0) << 24
    for batch in batches:
        columns = [batch.column("doc_id").to_pylist(), texts_of(batch, "text")]
        if extra:
            columns.append(batch.column(extra).to_pylist())
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[1])
            if size >= block_bytes:
                yield base + seq, rows
                seq, rows, size = seq + 1, [], 0
    if rows:
        yield base + seq, rows


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, payload) from rows (doc_id, text)."""

    def cut(batches):
        for block, rows in grouped(batches, block_bytes):
            rows.sort(key=lambda r: NO_ID if r[0] is None else r[0])
            ids = id_array(rows)
            lens = np.array([len(r[1]) for r in rows], np.int64)
            payload = squeeze(pack(ids, lens, b"".join(r[1] for r in rows)))
            # With a digest in its name: should a task that runs again cut other blocks, replies to the first ones are an error.
            block = block << 20 | zlib.crc32(payload) & 0xFFFFF
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": pa.array([payload], pa.binary()), "size": pa.array([int(lens.sum())], pa.int64())})

    return docs.mapInArrow(cut, BLOCK_SCHEMA)


def open_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, lengths in bytes, and the documents' bytes one after the other."""
    return tuple(unpack(expand(payload), np.int64, np.int64, bytes))


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MESSAGE.types, strict=True)], schema=_MESSAGE)


def ask(blocks: DataFrame, request: Callable[[int, bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Messages that each block alone sends: request(block, payload) gives (bucket, body)."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out := [(bucket, block, body) for bucket, body in request(block, payload.as_py())]:
                    yield messages(out)

    return blocks.mapInArrow(run, MESSAGE_SCHEMA)


def answer(requests: DataFrame, reply: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Messages back to blocks: reply(bucket, blocks, bodies) gives (block, body). A bucket's size is bounded by the number of buckets."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = [(bucket, block, body) for block, body in reply(bucket, table.column("block").to_pylist(), table.column("body").to_pylist())]
        return pa.Table.from_batches([messages(out)])

    return requests.groupBy("bucket").applyInArrow(run, MESSAGE_SCHEMA)


def meet(blocks: DataFrame, replies: DataFrame, use: Callable[[int, bytes, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Each block together with the replies to it: use(block, payload, bodies) gives result rows. A reply to no block is an error."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError(f"{left.num_rows} blocks of one id, {right.num_rows} replies")
        return use(left.column("block")[0].as_py(), left.column("payload")[0].as_py(), right.column("body").to_pylist())

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def meet_some(blocks: DataFrame, replies: DataFrame, use: Callable[[int, bytes, list[bytes]], pa.Table], always: bool = False) -> DataFrame:
    """As meet(), giving messages; without always, for the blocks alone that have a reply."""

    def some(block, payload, bodies):
        return use(block, payload, bodies) if bodies or always else pa.Table.from_batches([messages([])])

    return meet(blocks, replies, some, MESSAGE_SCHEMA)


#: Text that one hash bucket serves; what a bucket receives of it must fit a task.
BUCKET_BYTES = 128 << 20


def bucket_count(df: DataFrame, buckets: int | None = None, text_bytes: int = 0) -> int:
    """One for each BUCKET_BYTES of text, and at least as many as the session's shuffle partitions."""
    return buckets or max(1, -(-text_bytes // BUCKET_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bytes_in(blocks: DataFrame) -> int:
    """Bytes of text in settled blocks; reads one narrow column."""
    return blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def bytes_of(rows: DataFrame) -> int:
    """Bytes of text in rows (doc_id, text), without making blocks of them."""
    return rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its keys in their order), for the buckets that have keys."""
    where = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(where[order]) > 0)) if len(keys) else []
    for x, y in zip(cuts, [*cuts[1:], len(keys)], strict=False):
        yield int(where[order[x]]), order[x:y]


FIVE = np.uint64((1 << 40) - 1)


def shorten(keys: np.ndarray) -> bytes:
    """Low five bytes of each key: with the bucket enough for a filter, whose answers are verified later."""
    return np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def lengthen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()
