"""Plain versions of the operators, for small fixtures."""

import hashlib
from collections import Counter

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts, parts=3):
    rows = [(i, t, "en", None if (i or 0) % 9 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(docs):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit(1) for n in ("block", "n", "salt", "digest", "norm", "doc", "t", "w", "l", "i", "a", "b", "id", "failed", "runs")})


def substring(texts, width=20):
    seen, out = set(), {}
    for d, t in sorted(texts, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def suffix(texts, width=100):
    seen, out = set(), {}
    for d, t in sorted(texts, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            if k in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(k)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def lines(texts, least=4, words=10):
    """{(id, text): text that stays}; rows equal in both are one document."""
    out, held = {}, []
    for d, t in sorted(set(texts), key=lambda r: r[0]):
        whole = (t or "").split("\n")
        held.append((d, t, whole, [j for j, x in enumerate(whole) if x.encode().split()], set()))
    h = 1
    while any(len(at) >= h for _, _, _, at, _ in held):
        seen = set()
        for _, _, whole, at, gone in held:
            for k in range(len(at) - h + 1):
                run = tuple(whole[j] for j in at[k : k + h])
                if run in seen and (h >= least or sum(len(x.encode().split()) for x in run) >= words):
                    gone |= set(at[k : k + h])
                seen.add(run)
        h += 1
    for d, t, whole, _, gone in held:
        out[d, t] = "\n".join(x for j, x in enumerate(whole) if j not in gone)
    return out


def near(texts, size, similarity=80):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def rules(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    held = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), len(hit), len(held)
