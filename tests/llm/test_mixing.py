import numpy as np
import pytest
from samples import texts

from grove.llm import mixing


def test_raking_reaches_the_targets():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 5, 60), rng.integers(0, 3, 60), rng.integers(0, 4, 60)]
    tokens = rng.integers(1, 1000, 60)
    own = [np.bincount(c, tokens, c.max() + 1) for c in codes]
    goals = [x**0.7 / (x**0.7).sum() * tokens.sum() for x in own]
    weights = mixing.rake(tokens, codes, goals)
    for code, goal in zip(codes, goals):
        assert np.allclose(np.bincount(code, tokens * weights, len(goal)), goal, rtol=1e-6)


@pytest.mark.parametrize("share", [0.05, 0.5, 0.9, 0.999, 1.0])
def test_calibration_meets_the_budget(share):
    rng = np.random.default_rng(1)
    tokens, weights = rng.integers(1, 500, 40), rng.random(40) + 0.1
    f = mixing.calibrate(tokens, weights, share * tokens.sum())
    assert abs((tokens * np.minimum(1, f * weights)).sum() - share * tokens.sum()) < 1e-6 * tokens.sum()


def brute(rows):
    tokens, codes, goals = np.array([r.tokens for r in rows]), [], []
    cells = sorted({(r.source, r.lang, r.topic) for r in rows})
    at = {c: i for i, c in enumerate(cells)}
    sums = np.bincount([at[r.source, r.lang, r.topic] for r in rows], tokens, len(cells))
    now = sums.copy()
    targets = []
    for m in range(3):
        labels = sorted({c[m] for c in cells})
        own = {x: sum(s for c, s in zip(cells, sums) if c[m] == x) for x in labels}
        total = sum(v**0.7 for v in own.values())
        targets.append({x: own[x] ** 0.7 / total * sums.sum() for x in labels})
    for _ in range(400):
        for m in range(3):
            for x, goal in targets[m].items():
                part = [i for i, c in enumerate(cells) if c[m] == x]
                now[part] *= goal / now[part].sum()
    return {c: now[i] / sums[i] for c, i in at.items()}


def test_against_brute_force(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts())
    want = brute(rows)
    for r in rows:
        assert abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-3 * want[r.source, r.lang, r.topic] + 1e-6
        words = len((dict((i, t) for i, t in texts() if i == r.doc_id)[r.doc_id] or "").encode().split())
        assert r.tokens == max(words, 1)
    expected = sum(r.tokens * r.probability for r in rows)
    assert abs(expected - 0.7 * sum(r.tokens for r in rows)) < 1e-6 * expected


def test_same_sample_in_any_partitioning_and_growing(docs):
    taken = lambda df, keep: {r.doc_id for r in mixing.sample_mixed(df, keep=keep).collect()}
    half = taken(docs, 0.5)
    assert half == taken(docs.repartition(5), 0.5)
    assert half <= taken(docs, 0.8)
    assert mixing.sample_mixed(docs).columns == docs.columns


def test_tables_give_what_arrays_give(docs):
    a = {r.doc_id: r for r in mixing.mix(docs, rounds=1).collect()}  # eight rounds on arrays
    b = {r.doc_id: r for r in mixing.mix(docs, rounds=8, most_cells=1).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert abs(a[i].probability - b[i].probability) < 1e-6


def test_targets_topics_and_emptiness(spark, no_docs):
    df = spark.createDataFrame([(i, "w " * 10, "en", "ab"[i % 2], "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, lang string, source string, topic string")
    rows = mixing.mix(df, targets={"source": {"a": 0.9, "b": 0.1}}).collect()
    mass = {s: sum(r.tokens * r.weight for r in rows if r.source == s) for s in "ab"}
    assert abs(mass["a"] / sum(mass.values()) - 0.9) < 1e-6
    assert {r.topic for r in rows} == {"x", "y", "z"}
    assert mixing.mix(no_docs).count() == 0 and mixing.sample_mixed(no_docs).count() == 0


def test_tables_give_what_arrays_give_by_default(spark):
    """Margins that take 59 rounds to settle."""
    cells = [("a", "x", "t", 20), ("b", "y", "t", 10), ("a", "y", "t", 2), ("b", "x", "u", 3)]
    rows = [(10 * i, "w " * n, lang, source, topic) for i, (source, lang, topic, n) in enumerate(cells)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string").coalesce(1)
    a, b = ({r.doc_id: r for r in mixing.mix(df, most_cells=most).collect()} for most in (200_000, 1))
    assert a.keys() == b.keys() == {r[0] for r in rows}
    for i in a:
        assert abs(a[i].weight - b[i].weight) < 1e-9 and abs(a[i].probability - b[i].probability) < 1e-9


def test_labels_and_tokens_against_plain_python(spark):
    """Form, language, source and tokens from the texts themselves."""
    base = "word " * 60
    rows = texts() + [(500, base), (501, base + "|" * 20), (502, "<p>" * 90), (503, base + "#$%&" * 10), (504, base.upper()), (505, "12345 " * 50), (506, "a" * 199), (507, "a" * 200)]
    rows += [(508, base + "|" * 7), (509, base + "<" * 7), (510, base + "=" * 17), (511, base + "é" * 100), (512, "A" * 61 + "b" * 139), (513, "A" * 60 + "b" * 140)]

    def form(text):
        share = lambda chars: 100 * sum(c in chars for c in text)
        if len(text) < 200:
            return "short"
        rules = (("|", 2, "table"), ("<>", 2, "markup"), ("#$%&*@^~{}[]_=\\", 5, "symbols"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 30, "shouting"), ("0123456789", 10, "numbers"))
        return next((name for chars, most, name in rules if share(chars) > most * len(text)), "prose")

    df = spark.createDataFrame([(i, t, ["en", None][(i or 0) % 2], f"s{(i or 0) % 3}") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted(str((r.doc_id, r.source, r.lang, r.topic, r.tokens)) for r in mixing.labelled(df).collect())
    plain = lambda t: max(len((t or "").encode().split()), 1)
    assert got == sorted(str((i, f"s{(i or 0) % 3}", ["en", ""][(i or 0) % 2], form(t or ""), plain(t))) for i, t in rows)
