"""MinHash near-dedup by an LSH forest.

Each document becomes its set of word shingles and a signature of minimal hashes. Documents with equal sets are one class and
go on once. The forest is several sorted orders of the signatures: in tree t the label is the t-th stretch of the signature,
and the rows of all trees are dealt by range of (tree, label, id), so that a region that very many documents share is cut over
many tasks. Neighbours by longest common prefix are the first candidates; a region of at most REGION rows is compared by the
signatures, and a larger one is split at the next depth, which so adapts to each region, its parts kept together by pairs of
first members and of neighbours. These candidates, a few for each row and tree, are confirmed on the full sets, and confirmed
links are joined to components by alternating large and small stars.

That leaves regions (rows that agree to MIN_DEPTH in a tree) with several components. These are compared whole, whatever their
size: cut into blocks of bounded size, the blocks of one component never against each other. Pairs of blocks are dealt over
the tasks; signatures tell the rows that have a possible partner in another component, and for these rows alone the full sets
are fetched and all their intersections counted as a product of matrices. No pair is a row of any table: a pair of blocks
gives one link for each two components that it joins.

A pair of similarity 0.8 that shares no region in any tree is missed (0.59 ** 16, two in ten thousand pairs), and one whose
signatures agree in less than MAYBE of their parts (three in a hundred thousand), unless other links join the two. All others
are found. Very many different texts that are alike and yet not linked cost the square of their number in such products.

Null and empty texts have no shingles and no links. Repeated rows and equal texts are one class; rows of one id with different
texts are one document, linked by any of them. A row without an id is linked with equal sets alone. Very long texts are read whole. An empty table gives no rows. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K
from loomwright.llm.scratch import settle

SHINGLE = 5
SIMILARITY = 80
TREES = 16
DEPTH = 8
MIN_DEPTH = 4
REGION = 128
#: A block of a region is cut at about so many rows or shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
#: Share of equal signature parts from which a pair is confirmed, and from which one such pair is enough for a document.
MAYBE, SURE = 0.66, 0.88
_HASHES = TREES * DEPTH
_A, _B = (np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, _HASHES, np.uint64) | np.uint64(1) for seed in (7, 11))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each text; a text of fewer words is one shingle."""
    lens = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts).lower(), np.uint8)
    cuts = np.cumsum(lens)
    starts, ends = K.words(a, cuts)
    names = K.word_names(a, starts, ends)
    at = np.searchsorted(starts, np.concatenate(([0], cuts)))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = j - i
        yield np.unique(K.rolling(names[i:j], min(size, n))) if n else np.empty(0, np.uint64)


def signature(names: np.ndarray) -> np.ndarray:
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(names), 4096):
        low = np.minimum(low, (names[at : at + 4096, None] * _A + _B).min(axis=0))
    return (K.mix(low) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (null for an empty set)."""

    def run(batches):
        for _, rows in B.grouped(batches, B.BLOCK_BYTES):
            sets = list(shingle_sets([r[1] for r in rows], shingle))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([signature(s).byteswap().tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return B.document_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _compare(signs: np.ndarray) -> np.ndarray:
    """Shares of equal parts, corrected for parts of four bits that are equal by chance."""
    same = np.zeros((len(signs), len(signs)), np.float32)
    for c in range(signs.shape[1]):
        same += signs[:, c, None] == signs[None, :, c]
    return (same / signs.shape[1] - 1 / 16) / (15 / 16)


def region_pairs(ids: np.ndarray, labels: np.ndarray, signs: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Candidates in a region: rows in the order of their labels, which agree to this depth."""
    m = len(ids)
    if m < 2:
        return []
    if m <= REGION or depth >= labels.shape[1]:
        out = []
        for lo in range(0, m, REGION):  # more rows than that only if their labels are wholly equal; then neighbouring parts overlap by one
            hi = min(m, lo + REGION + 1)
            share = _compare(signs[lo:hi])
            np.fill_diagonal(share, 0)
            mine = ids[lo:hi]
            group = np.arange(hi - lo)  # the least row reachable over sure pairs
            via = np.full(hi - lo, -1)  # the row that this was last learned from: these pairs are a spanning forest
            strong = share >= SURE
            while True:
                reach = np.where(strong, group[None, :], hi - lo)
                nearest = reach.argmin(axis=1)
                new = reach[np.arange(hi - lo), nearest]
                lower = new < group
                if not lower.any():
                    break
                via[lower] = nearest[lower]
                group = np.minimum(group, new)
            has = via >= 0
            out += zip(mine[has].tolist(), mine[via[has]].tolist(), strict=True)
            weak = np.where((share >= MAYBE) & (group[:, None] != group[None, :]), share, 0)
            best = np.argsort(-weak, axis=1, kind="stable")[:, :4]
            rows, cols = np.nonzero(np.take_along_axis(weak, best, axis=1) > 0)
            out += zip(mine[rows].tolist(), mine[best[rows, cols]].tolist(), strict=True)
        return out
    cuts = np.flatnonzero(np.append(True, labels[1:, depth] != labels[:-1, depth]))
    ends = np.append(cuts[1:], m)
    out = []
    for x, y in zip(cuts.tolist(), ends.tolist(), strict=True):
        out += region_pairs(ids[x:y], labels[x:y], signs[x:y], depth + 1)
    if len(cuts) > 1:
        heads = np.argsort(ids[cuts], kind="stable")[:REGION]
        head = cuts[heads[0]]  # first members against the region's, and each against the row before it
        for other, k in ((np.full(len(cuts), head), cuts), (cuts[1:] - 1, cuts[1:])):
            share = ((signs[k] == signs[other]).mean(axis=1) - 1 / 16) / (15 / 16)
            out += [(a, b) for a, b, s in zip(ids[k].tolist(), ids[other].tolist(), share.tolist(), strict=True) if s >= MAYBE and a != b]
    return out


def candidates(classes: DataFrame, parts: int) -> DataFrame:
    """Two kinds of rows about classes (id, sig). (a, b), a > b: ids that the forest puts side by side. (a, tree, label): the rows of
    each region, but for rows that are alone in theirs."""

    def grow(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, TREES, 2 * DEPTH)
            nibbles = sig[:, :, 1::2].reshape(n, _HASHES) & 15
            packed = [x.tobytes() for x in nibbles[:, ::2] << 4 | nibbles[:, 1::2]]
            for t in range(TREES):
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(n, t), pa.int32()), "label": pa.array([x.tobytes() for x in sig[:, t]], pa.binary()), "id": batch.column("id"), "sign": pa.array(packed, pa.binary())})

    rows = classes.select("id", "sig").mapInArrow(grow, "tree int, label binary, id long, sign binary")
    ordered = rows.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")

    def sweep(batches):
        held: list[np.ndarray] | None = None

        def close(ids, trees, labels, signs, edge):
            """Pairs and members of whole regions; at an edge the first and last region may go on elsewhere."""
            fresh = np.append(True, (trees[1:] != trees[:-1]) | (labels[1:, :MIN_DEPTH] != labels[:-1, :MIN_DEPTH]).any(axis=1))
            cuts = np.flatnonzero(fresh)
            ends = np.append(cuts[1:], len(ids))
            pairs = []
            for x, y in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist(), strict=True):
                pairs += region_pairs(ids[x:y], labels[x:y], signs[x:y], MIN_DEPTH)
            pairs = {(max(p), min(p)) for p in pairs if p[0] != p[1]}
            a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            some = np.repeat(ends - cuts > 1, ends - cuts)
            if edge:
                some[: ends[0]] = some[cuts[-1] :] = True
            some = np.flatnonzero(some)
            short = np.ascontiguousarray(labels[some, :MIN_DEPTH].astype(">u2")).view(">i8").ravel().astype(np.int64)
            none = [None] * len(a)
            return pa.RecordBatch.from_pydict({
                "a": pa.array([*a, *ids[some].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()),
                "tree": pa.array([*none, *trees[some].tolist()], pa.int32()), "label": pa.array([*none, *short.tolist()], pa.int64()),
            })

        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            packed = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(n, -1)
            signs = np.stack((packed >> 4, packed & 15), axis=2).reshape(n, -1)
            labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(n, -1)
            new = [batch.column("id").to_numpy(), batch.column("tree").to_numpy(), labels, signs]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            ids, trees, labels, signs = new
            same = (trees == trees[-1]) & (labels[:, :MIN_DEPTH] == labels[-1, :MIN_DEPTH]).all(axis=1)
            cut = int(np.argmax(same))  # the last region may go on in the next batch
            if len(ids) - cut > 50_000:
                cut = len(ids) - 1  # first candidates of a region of very many rows come from parts of it, which share a row
                yield close(ids, trees, labels, signs, True)
                first = True
            elif cut:
                yield close(*(x[:cut] for x in new), first)
                first = False
            held = [x[cut:] for x in new]
        if held is not None:
            yield close(*held, True)

    return ordered.mapInArrow(sweep, "a long, b long, tree int, label long")


def _blocks(members: DataFrame) -> DataFrame:
    """(item, tree, id): the rows of each pair of blocks, of regions with several components; members: tree, label, id, component, n."""
    region = ["tree", "label"]
    needed = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    # Read back, so that a region's members aren't tied to the task that has counted them.
    mixed = settle(members.groupBy(*region).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), needed).where("lo < hi").select(*region, "blocks"), "regions")
    rows = settle(members.join(mixed, region).select(*region, "id", "component", "n", "blocks"), "mixed")
    small = rows.where("blocks = 1").select(F.xxhash64(*region).alias("item"), "tree", "id")
    large = rows.where("blocks > 1")
    # A component that fills blocks has blocks of its own; the others are dealt over common blocks.
    own = settle(large.groupBy(*region, "component").agg(needed.alias("own")).where("own > 1"), "own")
    number = F.pmod(F.xxhash64("id"), F.coalesce("own", F.lit(1)))
    whole = F.col("own").isNotNull()
    block = F.struct(whole.alias("whole"), F.when(whole, F.col("component")).otherwise(0).alias("of"), F.when(whole, number).otherwise(F.pmod(F.xxhash64("component"), F.col("blocks"))).alias("k"))
    large = settle(large.join(own, [*region, "component"], "left").select(*region, "id", block.alias("x")), "blocked")
    kinds = settle(large.select(*region, "x").distinct(), "kinds")
    work = kinds.join(kinds.withColumnRenamed("x", "y"), region).where("x <= y and not (x.whole and y.whole and x.of = y.of)")
    work = settle(work.select(*region, "x", "y", F.xxhash64(*region, "x", "y").alias("item")), "work")
    ends = work.select(*region, "x", "item").union(work.where("x <> y").select(*region, F.col("y").alias("x"), "item"))
    return small.unionByName(large.join(ends, [*region, "x"]).select("item", "tree", "id"))


def _possible(rows: DataFrame, parts: int) -> DataFrame:
    """(item, id): rows that have a possible partner in another component of the item, with which they share no earlier tree; rows: item, tree, id, component, sig."""
    ordered = rows.repartition(parts, "item").sortWithinPartitions("item")

    def found(trees, component, sigs, labels):
        """Which rows of one item have one."""
        m = len(sigs)
        out = np.zeros(m, bool)
        if m < 2 or (component == component[0]).all():
            return out
        for lo in range(0, m, 32):
            part = slice(lo, min(m, lo + 32))
            same = np.zeros((part.stop - lo, m), np.uint8)
            for c in range(_HASHES):
                same += sigs[part, c, None] == sigs[None, :, c]
            i, j = np.nonzero((same >= MAYBE * _HASHES) & (component[part, None] != component[None, :]))
            i += lo
            if len(i):
                met = (labels[i] == labels[j]) & (np.arange(TREES)[None, :] < trees[i, None])
                new = ~met.any(axis=1)
                out[i[new]] = out[j[new]] = True
        return out

    def run(batches):
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, _HASHES)
            new = [*[batch.column(c).to_numpy() for c in ("item", "tree", "id", "component")], sigs]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if cut:
                yield close(*(x[:cut] for x in new))
            held = [x[cut:] for x in new]
        if held is not None:
            yield close(*held)

    def close(item, trees, ids, component, sigs):
        cuts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        labels = np.ascontiguousarray(sigs.reshape(len(ids), TREES, DEPTH)[:, :, :MIN_DEPTH]).view(np.uint64)[:, :, 0]
        hit = np.concatenate([found(trees[x:y], component[x:y], sigs[x:y], labels[x:y]) for x, y in zip(cuts, np.append(cuts[1:], len(ids)), strict=True)])
        return pa.RecordBatch.from_pydict({"item": pa.array(item[hit], pa.int64()), "id": pa.array(ids[hit], pa.int64())})

    return ordered.mapInArrow(run, "item long, id long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, as products of 0/1 matrices over the names that at least two sets have."""
    sizes = [len(x) for x in sets]
    names, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    number = np.cumsum(times > 1) - 1
    keep = times[which] > 1
    row, column = row[keep], number[which[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(number[-1]) + 1 if len(names) else 0, 4096):
        x, y = np.searchsorted(column, (lo, lo + 4096))
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[x:y], column[x:y] - lo] = 1
        out += block @ block.T
    return out


def across(docs: DataFrame, classes: DataFrame, members: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int, similarity: int, parts: int) -> DataFrame:
    """(a, b): links between different components (found: id, component) in the regions (members: tree, label, id); one for each
    two components that a pair of blocks joins."""
    held = settle(classes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "n", "sig"), "held")
    items = _blocks(members.distinct().join(held.select("id", "component", "n"), "id"))
    wanted = settle(_possible(items.join(held.select("id", "component", "sig"), "id"), parts), "possible")
    names = _sets(docs, wanted.select("id").distinct(), id_col, text_col, shingle)
    rows = wanted.join(held.select("id", "component"), "id").join(names, "id")

    def link(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("names")]
        common, size = intersections(sets), np.array([len(x) for x in sets])
        i, j = np.nonzero((100 * common >= similarity * (size[:, None] + size[None, :] - common)) & (component[:, None] < component[None, :]))
        _, once = np.unique(np.stack((component[i], component[j]), axis=1), axis=0, return_index=True) if len(i) else (None, np.empty(0, np.int64))
        i, j = i[once], j[once]
        return pa.table({"a": pa.array(np.maximum(ids[i], ids[j]), pa.int64()), "b": pa.array(np.minimum(ids[i], ids[j]), pa.int64())})

    return rows.select("item", "id", "component", "names").groupBy("item").applyInArrow(link, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, names): the full sets of the wanted ids."""

    def sets(batches):
        for _, rows in B.grouped(batches, B.BLOCK_BYTES):
            found = list(shingle_sets([r[1] for r in rows], shingle))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            names = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "names": names})

    rows = B.document_rows(docs, id_col, text_col).join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return settle(rows.mapInArrow(sets, "id long, names array<long>"), "sets")


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= similarity * union."""
    wanted = settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    held = _sets(docs, wanted, id_col, text_col, shingle)
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("names").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("names").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))  # row by row in the JVM: a batch of pairs of long sets would be large
    return both.where(100 * common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that links reach, of every linked id but those least ones; alternating large and small stars until nothing changes."""
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        ways = links.union(links.select("b", "a"))
        least = settle(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large")
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        down = large.join(least, "a")
        links = settle(down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = settle(signatures(docs, id_col, text_col, shingle), "signatures")
    known = signed.where("digest is not null")
    classes = settle(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")).where("id is not null"), "classes")
    n_parts = B.bucket_count(docs, parts)
    forest = settle(candidates(classes, n_parts), "forest")
    pairs = settle(forest.where("tree is null").select("a", "b").distinct(), "pairs")
    members = forest.where("tree is not null").select("tree", "label", F.col("a").alias("id"))
    links = settle(confirm(docs, pairs, id_col, text_col, shingle, similarity), "confirmed")
    found = settle(components(links), "found")
    more = settle(across(docs, classes, members, found, id_col, text_col, shingle, similarity, n_parts), "across")
    if not more.isEmpty():  # links between components: these are joined in their turn
        at = lambda c: F.coalesce(F.col(c), F.col(c[0]))
        more = more.join(found.select(F.col("id").alias("a"), F.col("component").alias("a_component")), "a", "left").join(found.select(F.col("id").alias("b"), F.col("component").alias("b_component")), "b", "left")
        over = settle(components(more.select(at("a_component").alias("a"), at("b_component").alias("b"))), "over")
        whole = classes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
        found = settle(whole.join(over.select(F.col("id").alias("part"), "component"), "part", "left").select("id", F.coalesce("component", "part").alias("component")), "found")
    labels = settle(classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component")), "labels")
    return signed.join(labels, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
