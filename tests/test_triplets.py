"""Triplet distances from clade counts against all triplets, with polytomies and chains."""

import itertools
import random

from grove.operators import pairs


def made(seed, leaves):
    """A random tree over labelled leaves: (id, ancestor_id, label)."""
    rng = random.Random(seed)
    rows, ids = [], itertools.count()

    def grow(labels, up):
        own = next(ids)
        rows.append((own, own if up is None else up, labels[0] if len(labels) == 1 else None))
        if len(labels) == 1:
            return
        if rng.random() < 0.2:  # one child
            return grow(labels, own)
        labels = rng.sample(labels, len(labels))
        parts = rng.randint(2, min(4, len(labels)))
        cuts = [0, *sorted(rng.sample(range(1, len(labels)), parts - 1)), len(labels)]
        for a, b in zip(cuts, cuts[1:]):
            grow(labels[a:b], own)

    grow([f"t{i}" for i in range(leaves)], None)
    return rows


def outgroups(rows):
    up, leaf = {i: a for i, a, _ in rows}, {x: i for i, _, x in rows if x}

    def line(i):
        out = [i]
        while up[out[-1]] != out[-1]:
            out.append(up[out[-1]])
        return out[::-1]

    def depth(x, y):
        return sum(a == b for a, b in zip(line(leaf[x]), line(leaf[y])))

    found = {}
    for x, y, z in itertools.combinations(sorted(leaf), 3):
        d = [depth(y, z), depth(x, z), depth(x, y)]
        found[x, y, z] = d.index(max(d)) if d.count(max(d)) == 1 else -1
    return found


def test_triplet_distance_counts_all_triplets(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, ancestor_id long, taxon_label string")
    for seed, n in ((1, 9), (2, 14)):
        a, b = made(seed, n), made(seed + 50, n)
        x, y = outgroups(a), outgroups(b)
        want = sum(x[t] != y[t] for t in x) / len(x)
        assert abs(pairs.calc_triplet_distance(df(a), df(b)).first().distance - want) < 1e-12
    assert pairs.calc_triplet_distance(df(a), df(a)).first().distance == 0
