"""Byte-level BPE encoding and decoding through a global shuffle of the distinct pre-tokens.

Each block explodes its texts into pre-tokens. Its distinct words go to the buckets they hash to, where each distinct word of
the corpus is encoded once; their ids return to the blocks and are laid out by the positions of the pre-tokens. Decoding looks
ids up in the token-byte table, whose size the vocabulary bounds. The pre-tokens' positions and the words come from two scans
of the documents, which cut the same blocks from the same partitions. Both carry a digest of their block's texts and ids, and
the words of another block than the positions are an error, never wrong ids: rows must come in the same order each time they are
read, as from files or a settled table.

Null and empty texts have no ids and decode to the empty text; a null id stays null. Texts and words of any length are encoded
whole. Repeated rows, and rows of one id, are encoded each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm import tokens as T

BLOCK = 3 << 20
RESULT = "doc_id long, ids array<int>, text_bytes binary"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _cut(batches, block_bytes):
    for block, rows in B.grouped(batches, block_bytes):
        parts = [T.valid(x) for _, x in rows]
        lens = np.array([len(x) for x in parts], np.int64)
        text = b"".join(parts)
        print_ = hashlib.blake2b(text, digest_size=8, key=hashlib.blake2b(B.id_array(rows).tobytes() + lens.tobytes(), digest_size=16).digest()).digest()
        yield block, rows, text, lens, print_


def _parts(docs: DataFrame, id_col: str, text_col: str, rank_file: str, buckets: int, block_bytes: int):
    """(positions by block, ids of each block's words)."""
    rows = B.document_rows(docs, id_col, text_col)

    def ask(batches):
        for block, _, text, lens, print_ in _cut(batches, block_bytes):
            starts, names, first, _ = T.distinct_words(text, lens)
            begin, end = starts[first], np.append(starts[1:], len(text))[first]
            out = []
            for bucket, i in B.by_bucket(names, buckets):
                words = b"".join(text[a:b] for a, b in zip(begin[i].tolist(), end[i].tolist(), strict=True))
                out.append((bucket, block, B.squeeze(B.pack(print_, (end - begin)[i].astype(np.uint32), words), 3)))
            yield B.messages(out)

    def encode(bucket, blocks, bodies):
        number: dict[bytes, int] = {}
        wanted, prints = [], []
        for body in bodies:
            print_, sizes, words = B.unpack(B.expand(body), bytes, np.uint32, bytes)
            prints.append(print_)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            wanted.append(np.fromiter((number.setdefault(words[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
        look = T.rank_encoder(rank_file, public_tokenizers.PATTERN).encode_ordinary
        lists = [look(w.decode()) for w in number]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for one in lists for x in one), np.int32, int(counts.sum()))
        for block, which, print_ in zip(blocks, wanted, prints, strict=True):
            ids = T.take_lists(flat, counts, which)
            yield block, B.squeeze(B.pack(print_, np.array([bucket], np.int64), counts[which].astype(np.uint32), (ids & 0xFF).astype(np.uint8), (ids >> 8).astype(np.uint16)), 3)

    def lay_out(batches):
        for block, rows_, text, lens, print_ in _cut(batches, block_bytes):
            starts, names, _, which = T.distinct_words(text, lens)
            per_doc = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lens)))))
            ids = B.id_array(rows_)
            where = np.empty(len(names), np.int64)
            where[np.concatenate([i for _, i in B.by_bucket(names, buckets)]) if len(names) else []] = np.arange(len(names))
            place = where[which]
            times = np.argsort(-np.bincount(place, minlength=len(names)), kind="stable")  # frequent words get small numbers, which squeeze well
            small = np.empty(len(names), np.int64)
            small[times] = np.arange(len(names))
            place = small[place]
            planes = [(place >> s & 0xFF).astype(np.uint8) for s in (0, 8, 16, 24)]
            payload = B.pack(print_, ids, per_doc.astype(np.int64), times.astype(np.uint32), *planes)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": pa.array([B.squeeze(payload, 3)], pa.binary()), "size": pa.array([len(text)], pa.int64())})

    return rows.mapInArrow(lay_out, B.BLOCK_SCHEMA), B.answer(rows.mapInArrow(ask, B.MESSAGE_SCHEMA), encode)


def _laid_out(payload: bytes, bodies: list[bytes]):
    """Ids of documents, number of tokens of each, and all tokens."""
    print_, ids, per_doc, times, *planes = B.unpack(B.expand(payload), bytes, np.int64, np.int64, np.uint32, *[np.uint8] * 4)
    told = [B.unpack(B.expand(x), bytes, np.int64, np.uint32, np.uint8, np.uint16) for x in bodies]
    if any(x[0] != print_ for x in told):
        raise ValueError("the documents were read in another order the second time; settle them before")
    parts = sorted((x[1:] for x in told), key=lambda p: int(p[0][0]))
    counts = np.concatenate([np.empty(0, np.int64), *(p[1].astype(np.int64) for p in parts)])
    flat = np.concatenate([np.empty(0, np.int32), *(p[2].astype(np.int32) | p[3].astype(np.int32) << 8 for p in parts)])
    if len(counts) != len(times):
        raise ValueError(f"{len(counts)} words came back to a block of {len(times)}")
    place = sum(x.astype(np.int64) << s for x, s in zip(planes, (0, 8, 16, 24), strict=True))
    which = times[place].astype(np.int64)
    tokens = T.take_lists(flat, counts, which)
    upto = np.concatenate(([0], np.cumsum(counts[which])))
    ends = upto[np.cumsum(per_doc)]
    return ids, np.diff(ends, prepend=0), tokens


def _run(docs, use, schema, id_col, text_col, rank_file, buckets, block_bytes):
    n = B.bucket_count(docs, buckets, 0 if buckets else docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col].cast("string"))), F.lit(0))).first()[0])
    positions, words = _parts(docs, id_col, text_col, rank_file, n, block_bytes)
    return B.meet(positions, words, lambda block, payload, bodies: use(*_laid_out(payload, bodies)), schema)


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, buckets: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, ids and the bytes that the ids decode to, for every document."""
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def rows(ids, counts, tokens):
        table = T.token_bytes(rank_file)
        ends = np.cumsum(counts).tolist()
        lists = [tokens[b - n : b] for b, n in zip(ends, counts.tolist(), strict=True)]
        offsets = pa.array([0, *ends], pa.int32())
        return pa.table({"doc_id": B.id_column(ids), "ids": pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32())), "text_bytes": pa.array([b"".join(map(table.__getitem__, x.tolist())) for x in lists], pa.binary())})

    return _run(docs, rows, RESULT, id_col, text_col, rank_file, buckets, block_bytes)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, buckets: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, as encode_and_decode() with no ids or texts moved."""
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def rows(ids, counts, tokens):
        table = T.token_bytes(rank_file)
        said = [str(i) for i in range(len(table))]
        at, out = 0, []
        for n in counts.tolist():
            mine = tokens[at : at + n].tolist()
            at += n
            out.append((hashlib.sha256(" ".join(map(said.__getitem__, mine)).encode()).hexdigest(), hashlib.sha256(b"".join(map(table.__getitem__, mine))).hexdigest()))
        return pa.table({"doc_id": B.id_column(ids), "n_tokens": pa.array(counts.astype(np.int64)), "ids_sha256": [x for x, _ in out], "decoded_sha256": [x for _, x in out]}, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return _run(docs, rows, _DIGESTS, id_col, text_col, rank_file, buckets, block_bytes)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
