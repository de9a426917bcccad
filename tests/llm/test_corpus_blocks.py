import random

import numpy as np
import pytest

from loomwright.llm import blocks as B
from loomwright.llm import kernels as K
from loomwright.llm import tokens as T
from loomwright.llm.suffix_dedup import common_prefixes, group_suffixes


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(0, 40))] + [0]
        order = group_suffixes(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for a, b, n in zip(order, order[1:], common_prefixes(s, order)[1:]):
            assert s[a : a + n] == s[b : b + n] and s[a + n : a + n + 1] != s[b + n : b + n + 1]


def test_words_follow_bytes_split():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "é", " ", "\t", "\n", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 12))).encode() for _ in range(4)]
        a = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends = K.words(a, np.cumsum([len(t) for t in texts]))
        assert [a[i:j].tobytes() for i, j in zip(starts, ends)] == [w for t in texts for w in t.split()]


def test_names_depend_on_content_alone():
    text = b"one two three one two" + b"x" * 3 + b" " + b"y" * (2 << 20) + b" one"
    a = np.frombuffer(text, np.uint8)
    starts, ends = K.words(a, np.array([len(a)]))
    names = K.word_names(a, starts, ends)
    words = text.split()
    assert len(set(names.tolist())) == len(set(words))
    assert names[0] == names[3] == names[-1]
    for width in (1, 2, 3, 5):
        r = K.rolling(names, width)
        assert len(r) == len(words) - width + 1
        assert len(set(r.tolist())) == len({tuple(words[i : i + width]) for i in range(len(r))})


@pytest.mark.parametrize("seed", range(3))
def test_pretokens_follow_the_pattern(seed):
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(seed)
    for _ in range(1500):
        texts = ["".join(rng.choice("ab1 '  \n\tsétrevl.d!mé’²٣ 漢　\x1c\x85😀") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
        parts = [t.encode() for t in texts]
        whole = b"".join(parts)
        at = [*T.pretokens(whole, np.array([len(p) for p in parts], np.int64)).tolist(), len(whole)]
        assert [whole[i:j].decode() for i, j in zip(at, at[1:])] == [x for t in texts for x in pattern.findall(t)]


def test_packing_of_arrays_and_short_keys():
    keys = np.array([1, 1 << 39, (1 << 60) + 5], np.uint64)
    assert B.lengthen(B.shorten(keys)).tolist() == [1, 1 << 39, 5]
    a, b, c = B.unpack(B.pack(keys, b"xy", np.empty(0, np.int32)), np.uint64, bytes, np.int32)
    assert a.tolist() == keys.tolist() and b == b"xy" and len(c) == 0
