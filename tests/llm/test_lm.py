import math
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import texts

from grove.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"END "]


def model(rows, order):
    """The same model with dictionaries: p(words, place, order), counts, tokens."""
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        w = [b"START ", *tokens(t)]
        for k in range(1, order + 1):
            for e in range(k - 1, len(w)):
                if k > 1 or e > 0:
                    counts[k][tuple(w[e - k + 1 : e + 1])] += 1
        counts[1][(b"START ",)] += 1
    n = sum(c for g, c in counts[1].items() if g != (b"START ",))
    kinds = len(counts[1]) - bool(train)
    sums = np.zeros((order, lm.CLASSES, 2), np.int64)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            at = int(lm.count_class(np.array([counts[k - 1][g[:-1]]]))[0])
            sums[k - 1, at, 0] += c
            sums[k - 1, at, 1] += c == 1
    share = lm.shares(sums)

    def p(w, e, k):
        if k == 1:
            return (counts[1][(w[e],)] + 0.5) / (n + 0.5 * (kinds + 1))
        if e - k + 1 < 0:
            return p(w, e, k - 1)
        h = counts[k - 1][tuple(w[e - k + 1 : e])]
        if not h:
            return p(w, e, k - 1)
        s = share[k - 1][int(lm.count_class(np.array([h]))[0])]
        return s * counts[k][tuple(w[e - k + 1 : e + 1])] / h + (1 - s) * p(w, e, k - 1)

    return p, counts, n


def brute(rows, order):
    p, counts, n = model(rows, order)
    out = []
    for i, t in rows:
        w = [b"START ", *tokens(t)]
        base = sum(math.log10(p(w, e, 1)) for e in range(1, len(w)))
        score = sum(math.log10(p(w, e, order)) for e in range(1, len(w)))
        known = sum(counts[1][(x,)] > 0 for x in w[1:])
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w) - 1, known, n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [500, 1 << 22])
def test_against_brute_force(docs, order, block_bytes):
    got = sorted(map(tuple, lm.lm_scores(docs, order=order, block_bytes=block_bytes, keys_a_part=64).collect()), key=str)
    want = sorted(brute(texts(), order), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(order):
    """Of the model that the operator's scores agree with, after any history."""
    p, counts, _ = model(texts(), order)
    vocabulary = [g[0] for g in counts[1] if g != (b"START ",)] + [b"unknown "]
    for history in ([b"START "], [b"START ", b"one"], [b"one", b"two"], [b"two", b"unknown "], [b"unknown ", b"one"], [b"three", b"four"]):
        assert abs(sum(p([*history, w], len(history), order) for w in vocabulary) - 1) < 1e-9


def test_empty(no_docs):
    assert lm.lm_scores(no_docs).count() == 0


def test_pack():
    a, b = np.arange(5), np.array([1.5])
    x, y = lm._unpack(lm._pack(a, b), np.int64, np.float64)
    assert (x == a).all() and (y == b).all()
