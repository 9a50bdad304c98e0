import random

import numpy as np
from samples import WORDS, prose, texts

from grove.llm.near_dedup import estimate, keep_one_of_each, near_duplicates, registers, shingle_set


def shingles(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(df, **options).collect()
    want = components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_mixed_texts(spark):
    check(spark, [r for r in texts() if r[0] is not None])


def test_sizes_nulls_and_clashes(docs):
    got = near_duplicates(docs).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.doc_id, set()).add(r.n_shingles)
    for i, t in texts():
        assert len(shingles(t)) in sizes[i]
    assert len(got) == len(texts())


def test_family_of_edits_needs_more_than_stars(spark):
    """Edits of one text to all degrees: links that miss the smallest id must be found too."""
    rng, base, rows = random.Random(2), prose(9, 150).split(), []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(50))
        rows.append((1000 - i, " ".join(words)))
    check(spark, rows)
    check(spark, rows, block=1_000)  # many small blocks
    check(spark, rows, most_links=5)  # rounds of contraction


def test_texts_of_one_document_are_tied(spark):
    """Each of a doc_id's texts links it; the texts of different doc_ids cross."""
    a, b, c = (prose(k, 120) for k in (31, 32, 33))
    near = lambda x: x + " more"
    check(spark, [(1, a), (1, b), (2, near(a)), (3, near(b))])
    check(spark, [(5, a), (5, b), (5, a), (4, b), (4, c), (9, c), (8, near(c)), (7, near(a)), (6, prose(34, 90)), (10, None), (10, near(b)), (3, "")])
    check(spark, [(1, a)] * 40 + [(1, b)] * 40 + [(2, near(a))] * 3)


def test_components_of_any_shape(spark):
    from grove.llm.graph import connected_components
    from grove.llm.scratch import Scratch

    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1_000, 1_001 + i) for i in range(60)]
    bush = [(2_000 + rng.randrange(80), 2_000 + rng.randrange(80)) for _ in range(70)]
    edges = chain + star + bush + chain[:5]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (1_000, 20, 0):
        got = connected_components(df, Scratch(spark, "test"), "shape", bound).collect()
        assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(df.limit(0), Scratch(spark, "test"), "none", 0).count() == 0


def test_nothing_is_broadcast(spark):
    """Estimates miss what explode makes of rows: a broadcast they allow may not fit in the driver."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    rng, base = random.Random(3), prose(9, 150).split()
    rows = [(200 + i, prose(300 + i, 60)) for i in range(20)]
    for i in range(80):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(50))
        rows.append((100 - i, " ".join(words)))
    for more, options in (([], {}), ([], {"most_links": 5}), ([(100, prose(300, 60))], {})):  # arrays, rounds, several texts of a doc_id
        df = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(3)
        bus.waitUntilEmpty(30_000)
        before = {x.executionId() for x in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
        got = near_duplicates(df, **options).collect()
        keep_one_of_each(df).collect()
        bus.waitUntilEmpty(30_000)
        ran = store.executionsList()
        plans = [x.physicalPlanDescription() for x in (ran.apply(i) for i in range(ran.size())) if x.executionId() not in before]
        assert any("SortMergeJoin" in x for x in plans)
        assert not [x for x in plans if "Broadcast" in x]
        assert {r.doc_id: r.component_id for r in got} == components(rows + more)


def test_empty(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert keep_one_of_each(no_docs).columns == no_docs.columns


def test_keeps_columns_and_one_of_each(docs):
    kept = keep_one_of_each(docs.filter("doc_id is not null"))
    assert kept.columns == docs.columns
    want = components([r for r in texts() if r[0] is not None])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(want.values())


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    off = []
    for k in range(60):
        part = rng.choice(pool, 2_000, replace=False)
        a, b = np.unique(part[:1_600]), np.unique(part[400:])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = np.array([(registers(a) == registers(b)).sum()])
        off.append(estimate(equal, np.array([float(len(a))]), np.array([float(len(b))]))[0] - true)
    assert abs(np.mean(off)) < 0.03


def test_shingle_set_of_short_texts():
    assert len(shingle_set(None)) == len(shingle_set(b" \n")) == 0
    assert len(shingle_set(b"a b")) == len(shingle_set(b"a b c d e")) == 1
    assert shingle_set(b"A  b") == shingle_set(b"a b")
