"""Small trees of all shapes, and plain Python over them."""

from __future__ import annotations

import random


def shapes() -> dict[str, list[tuple[int, int]]]:
    rng = random.Random(1)
    random_tree = [(i, rng.randrange(i) if i else 0) for i in range(60)]
    forest = [(i, rng.randrange(1, i) if i > 1 and i % 11 else i) for i in range(1, 50)]
    names = rng.sample(range(1000), 40)
    sparse = [(names[i], names[rng.randrange(i)] if i else names[0]) for i in range(40)]
    rng.shuffle(sparse)
    return {
        "empty": [],
        "one": [(0, 0)],
        "two_roots": [(3, 3), (5, 5)],
        "chain": [(i, max(i - 1, 0)) for i in range(37)],
        "star": [(i, 0) for i in range(20)],
        "comb": [(i, max((i - 1) // 2 * 2, 0)) for i in range(21)],
        "balanced": [(i, max((i - 1) // 2, 0)) for i in range(31)],
        "random": random_tree,
        "forest": forest,
        "sparse": sparse,
    }


def table(spark, edges, **columns):
    """(id, ancestor_id, pos) and columns by functions of id."""
    names = ["id", "ancestor_id", "pos", *columns]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    sample = {c: kinds[type(f(7))] for c, f in columns.items()}
    schema = ", ".join(["id long", "ancestor_id long", "pos long", *(f"{c} {k}" for c, k in sample.items())])
    return spark.createDataFrame([(i, a, p, *(f(i) for f in columns.values())) for p, (i, a) in enumerate(edges)], schema).select(names).repartition(2)


def lineage(edges, i):
    up = dict(edges)
    out = [i]
    while up[out[-1]] != out[-1]:
        out.append(up[out[-1]])
    return out


def clade(edges, i):
    return [j for j, _ in edges if i in lineage(edges, j)]


def children(edges, i):
    return sorted(j for j, a in edges if a == i and j != i)


def leaves(edges):
    inner = {a for j, a in edges if a != j}
    return {j for j, _ in edges if j not in inner}
