"""Substring dedup over words by recompression.

Rounds name runs of equal tokens and then pairs of adjacent symbols. A name is a fixed function of the names that it joins, so
every executor gives equal substrings equal names without exchanging a dictionary. Which pairs join depends on the names alone:
inside a repeated window the parse is the same wherever the window stands, except near its two ends. Each window picks the
first boundary of the highest round that the window by itself proves to be there. Equal windows so pick the same place, and
high rounds have few boundaries, so neighbouring windows mostly share one place. The words after these places are the shared
symbols that reveal repeats: a Spark round finds the ones that occur twice. Another takes the stretches of text around them,
each distinct stretch once a block, to the bucket of their symbol, and verifies the repeats there: stretches, and windows of
stretches that differ, are compared by their very words, and the earliest copy is told.

A symbol with very many different surroundings would be one large group; its stretches are split, and each of their windows goes
by itself to the bucket of its own words.

Nulls and empty texts have no words and lose none; a null id counts as the least and stays null. Repeated rows are repeats like
any other: of two rows with one doc_id and equal texts, one stays whole (rows of one id should be made distinct before if that
matters). Texts of any length are read whole; one shorter than a window loses nothing. An empty table gives no rows. Columns other
than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K
from loomwright.llm.scratch import settle
from loomwright.llm.suffix_dedup import HOT, shared_probes

WINDOW = 20
PROBE = 8
ROUNDS = 6
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _parse(names: np.ndarray, doc: np.ndarray, rounds: int):
    """For each round: its boundaries as starts of symbols, the symbol of each word, and which symbols may only join to the left."""
    n = len(names)
    fresh = np.ones(n, bool)
    fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    size = np.diff(starts, append=n)
    sym = np.where(size > 1, K.mix(names[starts] * np.uint64(3) + size.astype(np.uint64)), names[starts])
    yield starts, None
    for t in range(rounds):
        right = (K.mix(sym + np.uint64(t * 2 + 1)) & np.uint64(1)).astype(bool)
        yield starts, right
        joins = ~right[:-1] & right[1:] & (doc[starts[:-1]] == doc[starts[1:]])
        first = np.append(joins, False)
        stays = np.ones(len(starts), bool)
        stays[1:] = ~joins
        nxt = np.append(sym[1:], np.uint64(0))
        sym = np.where(first, K.mix(sym * np.uint64(0x9E3779B97F4A7C15) + nxt), sym)[stays]
        starts = starts[stays]


def window_starts(doc: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that lie in one document."""
    if len(doc) < width:
        return np.empty(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])


def places(names: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int, probe: int, rounds: int) -> np.ndarray:
    """The place that each window [at, at + width) picks; at least probe words of the window follow it."""
    n = len(names)
    best = at.astype(np.int32)
    left, right = best.copy(), best + np.int32(width)
    limit = best + np.int32(width - probe)
    alive = np.ones(len(at), bool)
    for starts, kind in _parse(names, doc, rounds):
        mark = np.zeros(n + 1, np.int32)
        mark[starts] = 1
        symbol = np.cumsum(mark, dtype=np.int32) - 1
        symbol[n] = len(starts)
        ends = np.append(starts, n).astype(np.int32)
        if kind is None:  # a boundary of runs shows if both its words do
            after = np.where(mark[: n + 1] > 0, np.arange(n + 1, dtype=np.int32), ends[np.minimum(symbol + 1, len(starts))])
            after[n] = n
            left = after[np.minimum(left + 1, n)]
            right = ends[symbol[right - 1]]
        else:
            alive &= left < right  # the symbols at both ends are seen whole
            safe = np.minimum(left, n - 1)
            mine = symbol[safe]
            left = np.where(kind[mine], ends[mine + 1], left)
            last = symbol[np.maximum(right, 1) - 1]
            right = np.where(kind[last], right, ends[last])
        alive &= left <= right
        best = np.where(alive & (left <= limit), left, best)
    return best


class Block:
    """A block's words, and its stretches: runs of windows that pick one place.

    first, last: the words at which a stretch's first and last window begin; place: the word it picks; print: the name of the words
    there; kind: stretches with words of one kind may be equal. Words as bytes are only made where they are asked for.
    """

    def __init__(self, payload: bytes, width: int, probe: int):
        self.width = width
        self.ids, self.lens, self.text = B.open_block(payload)
        a = np.frombuffer(self.text, np.uint8)
        self.cuts = np.cumsum(self.lens)
        self.starts, self.ends = K.words(a, self.cuts)
        self.doc = np.searchsorted(self.cuts, self.starts, side="right").astype(np.int32)
        names = K.word_names(a, self.starts, self.ends)
        at = window_starts(self.doc, width)
        where = places(names, self.doc, at, width, probe, ROUNDS)
        fresh = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
        self.first = at[fresh]
        self.last = at[np.append(fresh[1:], len(at)) - 1] if len(at) else fresh
        self.place = where[fresh].astype(np.int64) if len(at) else fresh
        self.prints = K.rolling(names, probe)[self.place] if len(at) else np.empty(0, np.uint64)
        self.windows = K.rolling(names, width)
        self.kind = K.mix(self.windows[self.first] * np.uint64(3) + self.windows[self.last]) if len(at) else self.prints

    @cached_property
    def words(self) -> list[bytes]:
        return [w for x, y in zip((self.cuts - self.lens).tolist(), self.cuts.tolist(), strict=True) for w in self.text[x:y].split()]

    @cached_property
    def plain(self) -> bytes:
        return b" ".join(self.words)

    @cached_property
    def begin(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))

    def said(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words from the first window's to the last one's, joined by one space."""
        stop = self.begin[last + self.width] - 1
        return [self.plain[x:y] for x, y in zip(self.begin[first].tolist(), stop.tolist(), strict=True)]

    @cached_property
    def again(self) -> np.ndarray:
        """Which stretches have the words of an earlier one of the block."""
        out = np.zeros(len(self.first), bool)
        _, which, times = np.unique(self.kind, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[which] > 1)
        known: set[bytes] = set()
        for i, x in zip(some.tolist(), self.said(self.first[some], self.last[some]), strict=True):
            out[i] = x in known
            known.add(x)
        return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, buckets: int | None = None, block_bytes: int = B.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each word that a window of width words covers whose words also start earlier (a smaller id, or earlier in the document).

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (the words that stay, joined by one space).
    """
    probe = max(1, min(PROBE, width // 2))
    blocks = settle(B.to_blocks(B.document_rows(docs, id_col, text_col), block_bytes), "words")
    n_buckets = B.bucket_count(docs, buckets, B.bytes_in(blocks))

    def probes(block, payload):
        b = Block(payload, width, probe)
        prints, once = np.unique(b.prints, return_index=True)
        around = (b.kind[once] & np.uint64(255)).astype(np.uint8)
        for bucket, i in B.by_bucket(prints, n_buckets):
            yield bucket, B.pack(B.shorten(prints[i]), around[i])

    # A symbol also counts as shared if one block holds it in two stretches; the block sees that by itself.
    shared = shared_probes(B.ask(blocks, probes), hot)

    def stretches(block, payload, bodies):
        b = Block(payload, width, probe)
        told = [B.unpack(x, bytes, bytes) for x in bodies]
        few, many = (np.concatenate([np.empty(0, np.uint64), *(B.lengthen(x[i]) for x in told)]) for i in (0, 1))
        uniq, which, times = np.unique(b.prints, return_inverse=True, return_counts=True)
        split = np.isin(uniq & B.FIVE, many)
        hit = np.isin(uniq & B.FIVE, few) | split | (times > 1)
        once = np.flatnonzero(hit[which] & ~b.again) if hit.any() else np.empty(0, np.int64)
        apart = split[which][once]
        first, last, place, prints = b.first[once], b.last[once], b.place[once], b.prints[once]
        number = first  # a stretch is told by its first word
        shift = np.zeros(len(first), np.int64)
        if apart.any():  # each window of these stretches by itself
            n = (last - first + 1)[apart]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(first[apart], n) + inner
            whole = ~apart
            prints = np.concatenate((prints[whole], K.mix(b.windows[begin])))
            number = np.concatenate((number[whole], np.repeat(number[apart], n)))
            first, last, place, shift = (np.concatenate((x[whole], y)) for x, y in ((first, begin), (last, begin), (place, begin), (shift, inner)))
        doc = b.doc[first]
        at = place - np.searchsorted(b.doc, doc)
        out = []
        for bucket, i in B.by_bucket(prints, n_buckets):
            said = b.said(first[i], last[i])
            head = B.pack(prints[i], (last - first)[i].astype(np.uint16), (place - first)[i].astype(np.uint16), b.ids[doc[i]], at[i], number[i].astype(np.uint32), shift[i].astype(np.uint16), np.array([len(x) for x in said], np.uint32), b"".join(said))
            out.append((bucket, block, B.squeeze(head, 3)))
        return pa.Table.from_batches([B.messages(out)])

    def copies(bucket, blocks_, bodies):
        held: dict[int, dict[tuple[bytes, int], list]] = {}
        for k, body in enumerate(bodies):
            prints, more, offs, ids, at, number, shift, sizes, text = B.unpack(B.expand(body), np.uint64, np.uint16, np.uint16, np.int64, np.int64, np.uint32, np.uint16, np.uint32, bytes)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            begin = 0
            for p, m, o, d, x, n, s, end in zip(prints.tolist(), more.tolist(), offs.tolist(), ids.tolist(), at.tolist(), number.tolist(), shift.tolist(), ends, strict=True):
                held.setdefault(p, {}).setdefault((text[begin:end], o), []).append((d, x, k, m, n, s))
                begin = end
        gone: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
        for of_symbol in held.values():
            if len(of_symbol) == 1:
                (entries,) = of_symbol.values()
                least = min(e[:2] for e in entries)
                for d, x, k, m, n, s in entries:
                    if least < (d, x):
                        gone[k].append((n, s, s + m + 1))
                continue
            windows: dict[tuple[bytes, int], tuple[int, int]] = {}  # words, and the place among them: the earliest copy
            parted = []
            for (said, o), entries in of_symbol.items():
                words, least = said.split(b" "), min(e[:2] for e in entries)
                mine = [(b" ".join(words[j : j + width]), o - j) for j in range(len(words) - width + 1)]
                for w in mine:
                    if w not in windows or least < windows[w]:
                        windows[w] = least
                parted.append((mine, entries))
            for mine, entries in parted:
                for d, x, k, _, n, s in entries:
                    gone[k] += [(n, s + j, s + j + 1) for j, w in enumerate(mine) if windows[w] < (d, x)]
        for k, found in enumerate(gone):
            if found:
                yield blocks_[k], B.pack(*(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint32, np.uint16, np.uint16), strict=True)))

    found = B.answer(B.meet_some(blocks, shared, stretches, always=True), copies)

    def cut(block, payload, bodies):
        b = Block(payload, width, probe)
        start = np.zeros(len(b.doc) + 1, np.int32)  # windows that go, as a step function of their first words
        np.add.at(start, b.first[b.again], 1)
        np.subtract.at(start, b.last[b.again] + 1, 1)
        for body in bodies:
            number, lo, hi = B.unpack(body, np.uint32, np.uint16, np.uint16)
            np.add.at(start, number.astype(np.int64) + lo, 1)
            np.subtract.at(start, number.astype(np.int64) + hi, 1)
        gone = K.covered(np.flatnonzero(np.cumsum(start[:-1]) > 0), width, len(b.doc))
        n_words = np.bincount(b.doc, minlength=len(b.ids))
        n_gone = np.bincount(b.doc, weights=gone, minlength=len(b.ids)).astype(np.int64)
        ends = np.cumsum(n_words).tolist()
        kept = []
        for end, n, lost in zip(ends, n_words.tolist(), n_gone.tolist(), strict=True):
            mine = b.words[end - n : end]
            kept.append(b" ".join(compress(mine, (~gone[end - n : end]).tolist()) if lost else mine))
        return pa.table({"doc_id": B.id_column(b.ids), "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array(n_gone), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return B.meet(blocks, found, cut, RESULT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
