import random
import zlib

import numpy as np
from samples import prose, texts

from grove.llm import toxicity
from grove.llm.boosting import boost, isotonic


def labelled(n=900, seed=3):
    """Insults, partly of words that only the labels teach, in a tenth of the texts."""
    rng, docs, labels = random.Random(seed), [], []
    stems = ["grumbla", "vexoti"]
    for i in range(n):
        words = prose(10_000 + i, rng.randint(30, 200)).split(" ")
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["ka", "tor", "sh"]) if i % 2 else rng.choice(["idiot", "m0ron", "LOSER!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(d, toxicity.fit(d, y)).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert wrong <= 0.06 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = {r.doc_id for r in toxicity.drop_toxic(d, toxicity.fit(d, y)).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.5}


def test_odd_rows_and_labels(spark, docs):
    y = spark.createDataFrame([(i, i % 3 == 0, None) for i in range(20)] + [(3, False, None), (None, True, None), (999, True, None), (5, None, None)], "doc_id long, toxic boolean, quality int")
    model = toxicity.fit(docs, y)
    assert toxicity.score(docs, model).count() == len(texts())
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_without_labels_or_documents(spark, docs, no_docs):
    y = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, y)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, y)).count() == 0


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(0)
    score = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * score))).astype(float)
    at, value = isotonic(score, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    # The best rising fit is the largest, over starts, of the smallest mean, over ends.
    rising = y[np.argsort(score)]
    sums = np.concatenate(([0], np.cumsum(rising)))
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (b + 1 - a)
    best = [max(min(mean(a, b) for b in range(k, 300)) for a in range(k + 1)) for k in range(300)]
    assert np.allclose(sorted(set(np.round(best, 9))), value, atol=1e-8)
    assert np.allclose([sum(abs(x - v) < 1e-8 for x in best) for v in value], np.diff(np.searchsorted(np.sort(score), [*[np.sort(score)[best.index(x)] for x in sorted(set(best))], np.inf])))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:1_500], y[:1_500])
    assert ((model(x[1_500:]) > 0) == (y[1_500:] > 0)).mean() > 0.93


def test_features_of_a_text():
    table = toxicity.WordTable(toxicity.Lexicon(frozenset(["blib"]), frozenset(["zork"])))
    x = table.features("You IDIOT, zorkly m0ron idiooot! fine blib")
    assert x[4] == 1 and x[5] == 2 and x[6] == 5  # a fixed word, two learned ones, two hidden ones
    assert x[7] > 0 and x[8] == 1 / 7
    assert not table.features("").any()


def naive_features(text, words_learned, beginnings):
    """The features of a text, word by word, without a table."""
    words = text.split()
    if not words:
        return [0.0] * toxicity.FEATURES

    def core(w):
        places = [i for i, c in enumerate(w) if c.isalpha()]
        return w[places[0] : places[-1] + 1].lower() if places else ""

    learned = lambda c: c in words_learned or any(c.startswith(b) for b in beginnings)
    insult = [core(w) in toxicity.INSULTS for w in words]
    taught = [learned(core(w)) for w in words]
    second = [core(w) in toxicity.SECOND_PERSON for w in words]
    hidden, mixed, stretched = [], [], []
    for w in words:
        c = core(w)
        odd = bool(c) and any(not x.isalpha() for x in c)
        plain = "".join(x for x in c.translate(toxicity.LEET) if x.isalpha())
        runs = len(c) > 3 and any(c[i] == c[i + 1] == c[i + 2] for i in range(len(c) - 2))
        single = "".join(x for i, x in enumerate(c) if i == 0 or c[i - 1] != x)
        mixed.append(odd)
        stretched.append(runs)
        hidden.append(odd and (plain in toxicity.INSULTS or learned(plain)) or runs and (single in toxicity.INSULTS or learned(single)))
    hit = [a or b or c for a, b, c in zip(insult, taught, hidden)]
    near = [any(second[j] for j in range(len(words)) if abs(i - j) <= toxicity.NEAR) for i, h in enumerate(hit) if h]
    n, joined = len(words), "".join(words)
    letters, digits = sum(c.isalpha() for c in joined), sum(c.isdigit() for c in joined)
    upper = sum(c.isupper() for c in joined)
    shout = sum(sum(c.isalpha() for c in w) > 1 and sum(c.isupper() for c in w) == sum(c.isalpha() for c in w) for w in words)
    return [
        sum(insult) / n, sum(taught) / n, sum(hidden) / n, sum(hit) / n, min(sum(insult), 20), min(sum(taught), 20), min(sum(hit), 20),
        sum(near) / len(near) if near and any(second) else 0.0, sum(second) / n, upper / max(letters, 1), shout / n,
        (len(joined) - letters - digits) / max(len(joined), 1), joined.count("!") / max(len(joined), 1), digits / max(len(joined), 1), sum(mixed) / n,
        sum(stretched) / n, np.log1p(n), letters / n, sum(hidden),
    ]


def test_features_against_brute_force():
    rng = random.Random(8)
    learned, beginnings = {"blib", "taka"}, {"zork", "rebe"}
    table = toxicity.WordTable(toxicity.Lexicon(frozenset(learned), frozenset(beginnings)))
    pool = ["You", "du", "IDIOT", "m0ron", "idiooot!", "zorkly", "blib", "TAKA!!", "re8eka", "scheiße,", "l0sers", "(vos)", "x", "42", "!!!", "aaa", "baaaad", "WoRd", "$cum"]
    made = [" ".join(rng.choice(pool if rng.random() < 0.5 else prose(k, 9).split()) for _ in range(rng.randint(1, 60))) for k in range(200)]
    for text in made + [t for _, t in texts() if t and len(t) < 5_000]:
        assert np.allclose(table.features(text), naive_features(text, learned, beginnings)), text[:80]
