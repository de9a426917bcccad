"""Pre-tokens of byte-level BPE as array operations, and vocabularies.

Fixed pattern (that of the public rank files): 's 't 're 've 'm 'll 'd, then an optional space before letters, numbers or
other signs, then white space. The pattern is applied to all texts of a block at once by classes of code points.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, asked from the pattern library."""
    out = np.full(0x110000, OTHER, np.uint8)
    for begin, end in ((0, 0xD800), (0xE000, 0x110000)):  # all but surrogates
        text = np.arange(begin, end, dtype=np.uint32).tobytes().decode("utf-32-le")
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                out[begin + m.start() : begin + m.end()] = kind
    return out


def pretokens(text: bytes, lens: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens begin, over documents that lie one after the other; lens are in bytes."""
    c = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return np.empty(0, np.int64)
    wide = n != len(text)
    if wide:
        at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000), out=at[1:])
    cuts = np.cumsum(lens)
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(at, cuts) if wide else cuts] = True
    fresh[0] = fresh[n] = True
    kind = classes()[c]
    begin = fresh.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    token = begin.copy()
    runs = np.flatnonzero(begin)
    s, e = runs[:-1], runs[1:]
    inner = (kind[s] == SPACE) & ~fresh[e]
    e = e[inner]
    token[e - 1] = True
    token[e[c[e - 1] == 32]] = False
    p = np.flatnonzero(c == 39)
    p = p[token[p] & begin[p + 1] & ~fresh[p + 1]]
    if len(p):
        pad = np.append(c, np.zeros(3, np.uint32))
        one, two = pad[p + 1], pad[p + 2]
        same = ~fresh[np.minimum(p + 2, n)]
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = same & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for q, m in ((p[short], 1), (p[long & ~short], 2)):
            token[q + 1] = False
            token[q + 1 + m] = True
    out = np.flatnonzero(token[:n])
    return at[out] if wide else out


def valid(text: bytes) -> bytes:
    """UTF-8 as given; of bytes that are none, the replacement character."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


@lru_cache(4)
def rank_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    with open(path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def take_lists(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists numbered which, one after the other; list i has counts[i] items of flat."""
    begins = np.cumsum(counts) - counts
    n = counts[which]
    ends = np.cumsum(n)
    return flat[np.repeat(begins[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(2)
def json_encoder(path: str, pattern: str):
    """The byte-level BPE of a tokenizer file as a rank encoder: its ids are its ranks."""
    import json

    import tiktoken

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # these bytes stand for themselves, the rest for 256 and on
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"] for x in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def added_tokens(path: str) -> tuple[tuple[bytes, int], ...]:
    """(bytes, id) of the strings that a tokenizer file takes out of a text before anything else."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f).get("added_tokens", [])
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in told):
        raise ValueError(f"{path}: added tokens that take in white space or whole words alone are not supported")
    return tuple((x["content"].encode(), x["id"]) for x in told)


def split_added(text: bytes, added: tuple[tuple[bytes, int], ...]) -> tuple[list[bytes], list[int]]:
    """The pieces between the added tokens in a text, and the tokens' ids: one fewer than pieces. Leftmost first, the longest of those."""
    if not any(a in text for a, _ in added):
        return [text], []
    ids = dict(added)
    found = regex.split(b"(" + b"|".join(regex.escape(a) for a in sorted(ids, key=len, reverse=True)) + b")", text)
    return found[::2], [ids[x] for x in found[1::2]]


class WordIds:
    """Ids of pre-tokens, each distinct one encoded once while it is held; at most `most` are held, as flat arrays."""

    def __init__(self, encode, most: int = 4_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.names = np.empty(0, np.uint64)
        self.begins, self.counts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def look_up(self, text: bytes, starts: np.ndarray, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts) of the distinct words with these sorted names; first has the number of one pre-token of each."""
        if len(self.names) > self.most:
            self._clear()
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        new = np.flatnonzero(~known)
        ends = np.append(starts[1:], len(text))
        i = first[new]
        lists = [self.encode(text[a:b].decode()) for a, b in zip(starts[i].tolist(), ends[i].tolist(), strict=True)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for one in lists for x in one), np.uint32, int(counts.sum()))
        begins = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, flat))
        self.names = np.insert(self.names, at[new], names[new])
        self.begins = np.insert(self.begins, at[new], begins)
        self.counts = np.insert(self.counts, at[new], counts)
        at = np.searchsorted(self.names, names)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.begins[at] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts


def distinct_words(text: bytes, lens: np.ndarray):
    """Begins of the pre-tokens, the distinct ones' sorted names, the first of each, and the number of each pre-token's word."""
    from loomwright.llm import kernels as K

    starts = pretokens(text, lens)
    names = K.word_names(np.frombuffer(text, np.uint8), starts, np.append(starts[1:], len(text))) if len(starts) else np.empty(0, np.uint64)
    return (starts, *np.unique(names, return_index=True, return_inverse=True))
