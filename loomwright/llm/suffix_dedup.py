"""Suffix-array dedup over bytes, the suffix arrays built by linear grouping.

A string of 100 bytes can only repeat if its probe does: each window of `width` bytes picks, by the least fingerprint, one of
its own substrings, and equal windows pick the same one at the same offset. A Spark round finds the probes that
occur twice; the rest of the text is settled. The stretches of text around the shared probes then go, each distinct stretch
once a block, to the bucket of their probe: their 64-bit names and places, and of stretches that differ from others of their
probe also the bytes, sent by one block for all that hold the stretch. There the stretches of a probe that differ are aligned at
it, columns in which the same stretches agree become one symbol, and the suffixes of these symbol strings are sorted by grouping
(group_suffixes). The longest common prefixes cut the sorted order into intervals; each interval is one repeated string and its
least (id, position) is the copy that stays. Where all stretches of a probe are equal, their array is one interval and is not
sorted. Equal stretches are told by their names, within a block and between blocks.

A probe with very many different surroundings (HOT) would be one large group. Its stretches are split: the name of each of their
windows goes by itself to the bucket of that name, so no group holds more than equal windows and what a window costs is its name.

Null and empty texts have no bytes and lose none; a null id counts as the least and stays null. Repeated rows are repeats like
any other: of two rows with one id and equal texts one stays whole. Texts of any length are read whole. An empty table gives no
rows. Columns other than the id and the text are not read. A text may end in the middle of a character once bytes go, so the
kept text is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K

WIDTH = 100
HOT = 64
#: Larger than other operators' blocks: the longer a message to a bucket, the better it compresses.
BLOCK_BYTES = 4 << 20
#: What becomes of a stretch: it is the only one of its probe; its name goes to the bucket; its bytes too; its windows do.
ALONE, ALIKE, SENT, SPLIT = 0, 1, 2, 3
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def group_suffixes(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol is smaller than all others.

    First phase: suffixes are kept in groups by what is known of their Lyndon prefixes; the groups are taken from the greatest
    down. Each member's previous smaller suffix grows its prefix by the group's, so these suffixes move, by how many members
    point at them, into new groups just above the ones they leave. Second phase: from the least suffix up, the chain of
    previous smaller suffixes before each sorted suffix fills the next free place of each one's group.
    """
    n = len(s)
    count: dict[int, int] = {}
    for c in s:
        count[c] = count.get(c, 0) + 1
    begin, total = {}, 0
    for c in sorted(count):
        begin[c] = total
        total += count[c]
    group = [begin[c] for c in s]  # a group's name is the place where it begins
    size = [0] * n
    for c, at in begin.items():
        size[at] = count[c]
    order, place, free = [0] * n, [0] * n, dict(begin)
    for i, c in enumerate(s):
        at = free[c]
        order[at], place[i] = i, at
        free[c] = at + 1
    prev = [-1] * n
    end = n
    while end > 0:
        i = order[end - 1]
        g = group[i]
        if end - g == 1:  # a group of one: its pointer's target alone moves
            end, j = g, i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[old := group[j]] > 1:
                size[old] -= 1
                at = old + size[old]
                here, other = place[j], order[at]
                order[here], place[other] = other, here
                order[at], place[j] = j, at
                group[j], size[at] = at, 1
            continue
        hits: dict[int, int] = {}
        for i in sorted(order[g:end]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        end = g
        if not hits:
            continue
        by_count: dict[int, list[int]] = {}
        for j, k in hits.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:  # to the end of its group, where those of this count gather
                old = group[j]
                m = moved.get(old, 0)
                at = old + size[old] - 1 - m
                here, other = place[j], order[at]
                order[here], place[other] = other, here
                order[at], place[j] = j, at
                moved[old] = m + 1
            for old, m in moved.items():
                size[old] -= m
                if size[old]:
                    new = old + size[old]
                    size[new] = m
                    for at in range(new, new + m):
                        group[order[at]] = new
                else:
                    size[old] = m
    result, done, free_at = [-1] * n, [False] * n, {}
    result[0], done[n - 1] = n - 1, True
    for x in range(n):
        j = result[x] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = free_at.get(g, g)
            result[at], done[j] = j, True
            free_at[g] = at + 1
            j = prev[j]
    return result


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """Length of what each suffix in order shares with the one before it."""
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            h -= h > 0
        else:
            h = 0
    return out


def _stretches(a: np.ndarray, lens: np.ndarray, width: int, span: int):
    """Runs of windows that pick one probe: begins of the first and last window, the probe's place, its fingerprint.

    span: probes to choose from in each window; a probe has width - span + 1 bytes.
    """
    cuts = np.cumsum(lens)
    out = [[], [], [], []]
    size, chunk = width - span + 1, 1 << 20
    for base in range(0, len(a), chunk):  # windows that begin here; a stretch cut in two is still found by its probe
        part = a[base : base + chunk + width - 1]
        n = len(part) - width + 1
        if n <= 0:
            break
        codes = K.prefix_codes(part)
        start = np.arange(len(part) - size + 1)
        prints = K.spans(codes, start, start + size)
        least = (prints & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
        step = 1
        while 2 * step <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < span:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        lo, hi = np.searchsorted(cuts, (base, base + n - 1), side="right")
        ends = cuts[lo : hi + 1] - base
        room = np.repeat(ends, np.diff(np.minimum(ends, n), prepend=0)) - np.arange(n)
        at = np.flatnonzero(room >= width)
        if len(at):
            probe = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (probe[1:] != probe[:-1]) | (at[1:] != at[:-1] + 1)
            i = np.flatnonzero(fresh)
            j = np.append(i[1:], len(at)) - 1
            for to, x in zip(out, (at[i] + base, at[j] + base, probe[i] + base, prints[probe[i]]), strict=True):
                to.append(x)
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.uint64), strict=True)]


def _named(a: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """A name of each stretch [first, last + width); stretches ascend."""
    return K.word_names(a, first, last + width)


def _ragged(stretches: list[bytes], offsets: list[int], width: int, base: int):
    """Aligned at their probe: symbol strings of the stretches, and what windows need of them.

    Gives the rows, each (symbols, first run of columns, begin and end column), the first column of each run, the run of each
    column, and the next free symbol.
    """
    m, most = len(stretches), max(offsets)
    wide = max(most - o + len(x) for x, o in zip(stretches, offsets, strict=True))
    grid = np.full((m, wide), 256, np.int16)
    for i, (x, o) in enumerate(zip(stretches, offsets, strict=True)):
        grid[i, most - o : most - o + len(x)] = np.frombuffer(x, np.uint8)
    if m <= 24:
        label = (grid[None] == grid[:, None]).argmax(axis=1)
    else:
        label = np.empty((m, wide), np.int64)
        for c in range(wide):
            _, seen, which = np.unique(grid[:, c], return_index=True, return_inverse=True)
            label[:, c] = seen[which]
    edge = np.ones(wide, bool)
    edge[1:] = (label[:, 1:] != label[:, :-1]).any(axis=0)
    for x, o in zip(stretches, offsets, strict=True):
        edge[most - o] = True
        if most - o + len(x) < wide:
            edge[most - o + len(x)] = True
    run_at = np.flatnonzero(edge)
    run_of = np.cumsum(edge) - 1
    symbol = label[:, run_at] + np.arange(len(run_at)) * m + base
    rows = []
    for i, (x, o) in enumerate(zip(stretches, offsets, strict=True)):
        c0, c1 = most - o, most - o + len(x)
        r0, r1 = int(run_of[c0]), int(run_of[c1 - 1]) + 1
        rows.append((symbol[i, r0:r1].tolist(), r0, c0, c1))
    return rows, run_at, run_of, base + m * len(run_at)


def first_copies(groups: list[tuple[list[bytes], list[int], list[tuple]]], width: int) -> list[list[list[tuple[int, int, tuple]]]]:
    """For each group of different stretches of one probe, and each stretch: (from, to, owner) of its windows [from, to).

    owner is the least owner, over the stretches that hold the same window. Suffixes of all groups are sorted at once.
    """
    text: list[int] = []
    run_of_symbol, row_of_symbol = [], []  # runs are numbered over all groups
    shapes, runs, base = [], 0, 1 + sum(len(g[0]) for g in groups)
    mark = 1
    for stretches, offsets, _ in groups:
        rows, run_at, run_of, base = _ragged(stretches, offsets, width, base)
        shapes.append((rows, run_of, runs))
        for i, (symbols, r0, _, _) in enumerate(rows):
            run_of_symbol.extend(range(runs + r0, runs + r0 + len(symbols)))
            row_of_symbol.extend([i] * (len(symbols) + 1))
            run_of_symbol.append(-1)
            text.extend(symbols)
            text.append(mark)  # ends of stretches differ, so nothing is shared across one
            mark += 1
        runs += len(run_at)
    text.append(0)
    run_of_symbol.append(-1)
    order = group_suffixes(text)
    sorted_of: list[list[tuple[int, int]]] = [[] for _ in range(runs)]
    previous = -1
    for i, lcp in zip(order, common_prefixes(text, order), strict=True):
        r = run_of_symbol[i]
        if r >= 0:
            sorted_of[r].append((row_of_symbol[i], lcp if previous == r else 0))
        previous = r
    out = []
    for g, (stretches, _, owners) in enumerate(groups):
        rows, run_of, run0 = shapes[g]
        best: dict[tuple[int, int], dict[int, tuple]] = {}
        result = []
        a, b = run_of[: len(run_of) - width + 1], run_of[width - 1 :]
        cuts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], a[cuts].tolist(), (b[cuts] - a[cuts] + 1).tolist(), strict=True))
        for i, (_, _, c0, c1) in enumerate(rows):
            found: list[tuple[int, int, tuple]] = []
            for x, y, r, need in parts:  # windows that begin in one run of columns and end in another are alike
                lo, hi = max(x, c0), min(y, c1 - width + 1)
                if lo >= hi:
                    continue
                key = (r, need)
                if key not in best:
                    least: dict[int, tuple] = {}
                    interval: list[int] = []
                    for row, lcp in [*sorted_of[run0 + r], (-1, -1)]:
                        if lcp < need and interval:
                            first = min(owners[k] for k in interval)
                            for k in interval:
                                least[k] = first
                            interval = []
                        interval.append(row)
                    best[key] = least
                owner = best[key][i]
                if found and found[-1][2] == owner:
                    found[-1] = (found[-1][0], hi - c0, owner)
                else:
                    found.append((lo - c0, hi - c0, owner))
            result.append(found)
        out.append(result)
    return out


def shared_probes(requests: DataFrame, hot: int) -> DataFrame:
    """Replies with the shortened probes that at least two blocks sent: those with few surroundings, and those with very many."""

    def reply(bucket, blocks, bodies):
        parts = [B.unpack(x, bytes, np.uint8) for x in bodies]
        keys = [B.lengthen(x) for x, _ in parts]
        names, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        around = np.unique(which.astype(np.int64) << 8 | np.concatenate([x for _, x in parts]))
        many = np.bincount(around >> 8, minlength=len(names)) >= hot
        at = 0
        for block, mine in zip(blocks, keys, strict=True):
            i = which[at : at + len(mine)]
            at += len(mine)
            shared = counts[i] > 1
            if shared.any():
                yield block, B.pack(B.shorten(mine[shared & ~many[i]]), B.shorten(mine[shared & many[i]]))

    return B.answer(requests, reply)


def told_stretches(requests: DataFrame, hot: int) -> DataFrame:
    """Replies with a code for each stretch that a block has told of, in its order: see ALONE, ALIKE, SENT and SPLIT."""

    def reply(bucket, blocks, bodies):
        # In the order of the blocks: a task that runs again must ask the same block for a stretch's bytes.
        by_block = sorted(range(len(blocks)), key=blocks.__getitem__)
        parts = [B.unpack(bodies[k], np.uint32, bytes) for k in by_block]
        keys, names = np.concatenate([x for x, _ in parts]), np.concatenate([B.lengthen(x) for _, x in parts])
        order = np.lexsort((names, keys))
        new_key, new_name = np.ones(len(order), bool), np.ones(len(order), bool)
        new_key[1:] = np.diff(keys[order]) != 0
        new_name[1:] = new_key[1:] | (np.diff(names[order]) != 0)
        at = np.flatnonzero(new_key)
        entries, different = np.diff(np.append(at, len(order))), np.add.reduceat(new_name.astype(np.int64), at)
        of_key = np.where(entries == 1, ALONE, np.where(different == 1, ALIKE, np.where(different < hot, SENT, SPLIT))).astype(np.uint8)
        sorted_code = np.repeat(of_key, entries)
        sorted_code[(sorted_code == SENT) & ~new_name] = ALIKE  # one block sends the bytes
        code = np.empty(len(order), np.uint8)
        code[order] = sorted_code
        begin = 0
        for k, (mine, _) in zip(by_block, parts, strict=True):
            x = code[begin : begin + len(mine)]
            begin += len(mine)
            if x.any():
                yield blocks[k], B.squeeze(B.pack(np.array([bucket], np.int64), x))

    return B.answer(requests, reply)


def _head(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places in a block, ascending: ids and starts of the documents that hold them, and the places, as differences that compress."""
    doc = np.unique(np.searchsorted(starts, at, side="right") - 1)
    return np.diff(ids[doc], prepend=np.int64(0)), starts[doc].astype(np.uint32), np.diff(at, prepend=0).astype(np.uint32)


def _owners(heads: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], offs: list[np.ndarray]) -> np.ndarray:
    """A number for each place of each (block, ids, starts, places) of _head, in the order of (id, row, place in the row)."""
    ids, starts = np.concatenate([np.cumsum(h[1]) for h in heads]), np.concatenate([h[2] for h in heads])
    order = np.lexsort((starts, np.repeat([h[0] for h in heads], [len(h[1]) for h in heads]), ids))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out, base = [], 0
    for (_, _, begins, at), off in zip(heads, offs, strict=True):
        doc = np.searchsorted(begins, at, side="right") - 1
        out.append(rank[base + doc] << 32 | (at + off - begins[doc]))
        base += len(begins)
    return np.concatenate(out)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte that a string of width bytes covers which also starts earlier (a smaller id, or earlier in the document).

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept.
    """
    span = max(1, width * 64 // 100)
    rows = B.document_rows(docs, id_col, text_col)
    # The one copy of the texts on disk: all three rounds read this shuffle.
    blocks = B.to_blocks(rows, block_bytes).drop("size").repartition("block")
    n_buckets = B.bucket_count(docs, buckets, B.bytes_of(rows))

    def different(a, lens):
        """The stretches that differ within a block, the first of each, in the order of their places; the last column is their names."""
        first, last, probe, prints = _stretches(a, lens, width, span)
        names = _named(a, first, last, width)
        _, once = np.unique(names, return_index=True)
        once.sort()
        return [x[once] for x in (first, last, probe, prints, names)]

    def probes(block, payload):
        _, lens, text = B.open_block(payload)
        _, _, _, prints, names = different(np.frombuffer(text, np.uint8), lens)
        for bucket, i in B.by_bucket(prints, n_buckets):
            yield bucket, B.pack(prints[i].astype(np.uint32), B.shorten(names[i]))

    told = told_stretches(B.ask(blocks, probes), hot)

    def stretches(block, payload, bodies):
        ids, lens, text = B.open_block(payload)
        a = np.frombuffer(text, np.uint8)
        first, last, probe, prints, names = different(a, lens)
        starts = np.cumsum(lens) - lens
        full = lens > 0  # empty documents begin where the next one does
        ids, starts = ids[full], starts[full]
        codes = {int(b[0]): x for b, x in (B.unpack(B.expand(body), np.int64, np.uint8) for body in bodies)}
        code = np.zeros(len(first), np.uint8)
        for bucket, i in B.by_bucket(prints, n_buckets):
            if bucket in codes:
                code[i] = codes[bucket]
        out = []
        whole = np.flatnonzero((code == ALIKE) | (code == SENT))
        for bucket, i in B.by_bucket(prints[whole], n_buckets):
            i = whole[i]
            sent = i[code[i] == SENT]
            body = b"".join(text[x:y] for x, y in zip(first[sent].tolist(), (last[sent] + width).tolist(), strict=True))
            head = _head(ids, starts, first[i])
            out.append((bucket, block, B.squeeze(B.pack(*head, prints[i].astype(np.uint32), names[i], (last - first)[i].astype(np.uint16), (probe - first)[i].astype(np.uint16), code[i], body), 3)))
        split = code == SPLIT
        if split.any():  # each window of these stretches by itself, by name
            n = (last - first + 1)[split]
            begin = np.repeat(first[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            salt = np.repeat(prints[split].astype(np.uint16), n)  # equal windows have one probe
            names = _named(a, begin, begin, width)
            for bucket, i in B.by_bucket(names, n_buckets):
                out.append((bucket, block, B.squeeze(B.pack(*_head(ids, starts, begin[i]), salt[i], names[i]))))
        return pa.Table.from_batches([B.messages(out)])

    def copies(bucket, blocks_, bodies):
        wholes, windows = [], []
        for k, body in enumerate(bodies):
            body = B.expand(body)
            if np.frombuffer(body, np.int64, 1)[0] == 5:
                windows.append((k, *B.unpack(body, np.int64, np.uint32, np.uint32, np.uint16, np.uint64)))
            else:
                wholes.append((k, *B.unpack(body, np.int64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint16, np.uint16, np.uint8, bytes)))
        found: list[list[np.ndarray]] = [[], [], [], []]  # message, place in its block, windows [from, to) after it

        def gone(*columns):
            for to, x in zip(found, columns, strict=True):
                to.append(np.asarray(x, np.int64))

        def gather(parts, offs):
            """Of all messages: which one, places, owners, keys and names; and their order by key, name and owner, with where keys and names begin."""
            heads = [(blocks_[m[0]], m[1], m[2].astype(np.int64), np.cumsum(m[3].astype(np.int64))) for m in parts]
            which = np.repeat([m[0] for m in parts], [len(m[3]) for m in parts])
            at, owner = np.concatenate([h[3] for h in heads]), _owners(heads, offs)
            keys, names = (np.concatenate([m[c] for m in parts]) for c in (4, 5))
            order = np.lexsort((owner, names, keys))
            new_key, new_name = np.ones(len(order), bool), np.ones(len(order), bool)
            new_key[1:] = np.diff(keys[order]) != 0
            new_name[1:] = new_key[1:] | (np.diff(names[order]) != 0)
            return which[order], at[order], owner[order], new_key, new_name, order

        if windows:
            which, at, _, _, new_name, _ = gather(windows, [0] * len(windows))
            later = ~new_name
            gone(which[later], at[later], np.zeros(later.sum()), np.ones(later.sum()))
        if wholes:
            offs = [m[7].astype(np.int64) for m in wholes]
            which, at, owner, new_key, new_name, order = gather(wholes, offs)
            more, off, code = np.concatenate([m[6] for m in wholes])[order].astype(np.int64), np.concatenate(offs)[order], np.concatenate([m[8] for m in wholes])[order]
            names_at, keys_at = np.flatnonzero(new_name), np.flatnonzero(new_key)
            one = np.repeat(np.add.reduceat(new_name.astype(np.int64), keys_at) == 1, np.diff(np.append(keys_at, len(order))))
            later = one & ~new_name
            gone(which[later], at[later], np.zeros(later.sum()), more[later] + 1)
            # Where the bytes of a stretch that was sent begin, in all messages' bytes one after the other.
            text = b"".join(m[9] for m in wholes)
            lens = np.concatenate([np.where(m[8] == SENT, m[6].astype(np.int64) + width, 0) for m in wholes])
            text_at = (np.cumsum(lens) - lens)[order]
            ends = np.append(names_at[1:], len(order))
            # Probes whose short keys are equal by chance share a group; no window of theirs is equal, so nothing comes of it.
            ragged, waiting = [], []

            def settle_ragged():
                late: list[list[int]] = [[], [], [], []]
                for ranges, groups in zip(first_copies(ragged, width), waiting, strict=True):
                    for r, (x, y) in zip(ranges, groups, strict=True):
                        for o, w, p in zip(owner[x:y].tolist(), which[x:y].tolist(), at[x:y].tolist(), strict=True):
                            for lo, hi, least in r:
                                if least < o:
                                    for to, v in zip(late, (w, p, lo, hi), strict=True):
                                        to.append(v)
                gone(*late)
                ragged.clear()
                waiting.clear()

            load, held = 0, None
            sent = code == SENT
            for x, y in zip(names_at[~one[names_at]].tolist(), ends[~one[names_at]].tolist(), strict=True):
                if new_key[x]:
                    if load > 5000:
                        settle_ragged()
                        load = 0
                    held = ([], [], [])
                    ragged.append(held)
                    waiting.append([])
                i = x + int(sent[x:y].argmax())
                if not sent[i]:
                    raise ValueError("no block has sent the bytes of a stretch that differs from others of its probe: two names are equal in their low five bytes")
                begin = int(text_at[i])
                for to, v in zip(held, (text[begin : begin + int(more[i]) + width], int(off[i]), int(owner[x])), strict=True):
                    to.append(v)
                waiting[-1].append((x, y))
                load += 1
            if ragged:
                settle_ragged()
        which, at, lo, hi = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        order = np.lexsort((lo, at, which))
        cuts = np.searchsorted(which[order], np.arange(len(bodies) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            i = order[cuts[k] : cuts[k + 1]]
            yield blocks_[k], B.squeeze(B.pack(np.diff(at[i], prepend=0).astype(np.uint32), lo[i].astype(np.uint16), hi[i].astype(np.uint16)))

    found = B.answer(B.meet_some(blocks, told, stretches), copies)

    def cut(block, payload, bodies):
        ids, lens, text = B.open_block(payload)
        a = np.frombuffer(text, np.uint8)
        first, last, _, _ = _stretches(a, lens, width, span)
        names = _named(a, first, last, width)
        _, once = np.unique(names, return_index=True)
        start = np.zeros(len(a) + 1, np.int32)  # windows that go, as a step function of their begins
        again = np.ones(len(first), bool)
        again[once] = False
        np.add.at(start, first[again], 1)
        np.subtract.at(start, last[again] + 1, 1)
        for body in bodies:
            at, lo, hi = B.unpack(B.expand(body), np.uint32, np.uint16, np.uint16)
            at = np.cumsum(at.astype(np.int64))
            np.add.at(start, at + lo, 1)
            np.subtract.at(start, at + hi, 1)
        gone = K.covered(np.flatnonzero(np.cumsum(start[:-1]) > 0), width, len(a)) if len(a) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(ids)), lens)
        n_gone = np.bincount(doc[gone], minlength=len(ids))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        n_spans = np.bincount(doc[opens], minlength=len(ids))
        kept, at = [], 0
        for d, n in enumerate(lens.tolist()):
            kept.append(a[at : at + n][~gone[at : at + n]].tobytes() if n_gone[d] else text[at : at + n])
            at += n
        return pa.table({"doc_id": B.id_column(ids), "n_bytes": pa.array(lens), "n_removed": pa.array(n_gone.astype(np.int64)), "n_spans": pa.array(n_spans.astype(np.int64)), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": pa.array(kept, pa.binary())})

    return B.meet(blocks, found, cut, RESULT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
