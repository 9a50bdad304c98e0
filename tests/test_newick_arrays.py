"""Reading Newick by arrays gives what reading it token by token gives."""

import random
import time

import pytest

from grove.sources.newick import NewickError, parse_arrays, parse_newick


def same(text):
    got = parse_arrays(text)
    if got is not None:
        ancestors, labels, lengths, trees = parse_newick(text)
        assert (got[0].tolist(), got[1].to_pylist(), got[2].to_pylist(), got[3]) == (ancestors, labels, lengths, trees), text
    return got is not None


@pytest.mark.parametrize("text", ["a;", "(a,b)c;", "((a:1,b:2.5)x:3,c)r;", " ( a , (b b, c) ) r ; \n", "(,);", "((),());", "a;b;(c,d);", "(a,b)", "(é:1e-3,ü:-2)ß:0;", "((((a))));", "(a:,b)c;"])
def test_plain_texts(text):
    assert same(text)


@pytest.mark.parametrize("text", ["", ";", ";;", "('a b',c);", "(a[x],b);", "(a,b", "a,b;", "(a))", "(a,b)(c);", "a(b);", "(a:x,b);", "(a::1);", "(a\tb,c);", "x;(a"])
def test_odd_texts_go_the_other_way(text):
    assert not same(text)


def test_random_texts():
    rng = random.Random(3)

    def tree(depth):
        name = rng.choice(["", "a", "bc", "\u00e9x", "t 1"]) + rng.choice(["", "", ":1", ":0.25", ":1e-2"])
        if depth == 0 or rng.random() < 0.3:
            return name
        return "(" + rng.choice(["", " ", "\n"]).join(["", rng.choice([",", " , "]).join(tree(depth - 1) for _ in range(rng.randint(1, 4)))]) + ")" + name

    for _ in range(300):
        text = rng.choice([";", "; ", ";\n"]).join(tree(rng.randint(0, 5)) for _ in range(rng.randint(1, 3))) + rng.choice(["", ";"])
        if same(text) is False:
            assert not text.strip(" ;\n") or ";" in text
    # Cut or doubled at random: an error, or the same.
    for _ in range(300):
        text = tree(4) + ";"
        at = rng.randrange(len(text))
        broken = text[:at] + text[at + 1 :] if rng.random() < 0.5 else text[:at] + rng.choice("(),:;") + text[at:]
        try:
            parse_newick(broken)
        except (NewickError, ValueError):
            assert parse_arrays(broken) is None, broken
        else:
            same(broken)


def test_a_caterpillar_takes_no_loop():
    n = 100_000
    text = "(" * n + "a" + "".join(f",b{i})" for i in range(n)) + ";"
    began = time.perf_counter()
    ancestors, labels, _, trees = parse_arrays(text)
    assert time.perf_counter() - began < 3 and len(ancestors) == 2 * n + 1 and trees == 1
    assert labels[n].as_py() == "a" and ancestors[n].item() == n - 1
