import numpy as np
import pytest

from grove.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, ids string, id string").repartition(3)


def brute(rows, k=20):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16:
            seen[i, tuple(v)] = None
    ids = np.array([i for i, _ in seen])
    x = np.array([v for _, v in seen], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def rows(n, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dims).astype(np.float32).tolist()) for i in range(n)]


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_odd_vectors_ties_and_copies(spark):
    data = rows(150) + [(200 + i, [1.0] * 16) for i in range(60)]
    data += [(300, None), (320, []), (340, [0.0] * 16), (360, [None] + [1.0] * 15), (380, [float("nan")] * 16), (400, [float("inf")] * 16), (420, [1.0] * 3), (None, [1.0] * 16)]
    data += [(140, data[140][1])]  # a repeated row
    mine, want = got(ann.nearest(frame(spark, data))), brute(data)
    assert mine.keys() == want.keys()
    for q in want:
        assert [v for v, _ in mine[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in want[q]])


def test_fewer_candidates_than_asked(spark):
    data = rows(7)
    assert {q: [v for v, _ in x] for q, x in got(ann.nearest(frame(spark, data))).items()} == {q: [v for v, _ in x] for q, x in brute(data).items()}


def test_recall_with_blocks_and_a_small_sample(spark):
    data = rows(3000, 5)
    mine = got(ann.nearest(frame(spark, data), sample_rows=600, index_block=400, query_block=40))
    want = brute(data)
    hits = [len({v for v, _ in mine[q]} & {v for v, _ in want[q]}) for q in want]
    assert all(len(mine[q]) == 20 for q in want)
    assert sum(hits) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("data", [[], [(0, None)], [(20, [1.0, 0.0])]])
def test_nothing_to_find(spark, data):
    assert ann.nearest(frame(spark, data)).count() == 0


@pytest.mark.parametrize("radius", [0, 5, 16, 40, 100, 256])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(1)
    index = rng.integers(0, 1 << 16, (500, ann.PARTS), dtype=np.uint16)
    near = index[:50] ^ (rng.integers(0, 1 << 16, (50, ann.PARTS), dtype=np.uint16) & rng.integers(0, 1 << 16, (50, ann.PARTS), dtype=np.uint16))
    assert (ann.probe(index, near, radius) == (ann.hamming(near, index) <= radius)).all()
