"""Texts that the tests share."""

import random

WORDS = [f"{a}{b}" for a in ("re", "ta", "mo", "li", "su", "ne") for b in ("ka", "bel", "tor", "vin", "shu", "gra", "pol")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def texts() -> list[tuple]:
    """Documents with nulls, empty and blank texts, copies, near copies, repeated rows, a very long text and odd characters."""
    base = prose(1, 300)
    rows = [(i, prose(100 + i, 40 + i)) for i in range(20)]
    rows += [(20, base), (21, base.replace(" ", "  ")), (22, base), (22, base), (23, base.rsplit(" ", 3)[0] + " ending otherwise here"), (24, base.upper())]
    rows += [(25, None), (26, ""), (27, " \n\t\x0b\x0c\r "), (28, "one two three"), (29, "One  two THREE"), (30, "one two three four five")]
    rows += [(31, prose(5, 30_000)), (32, "é́ ü　 q　a\u0085b 😀 don't I'll 'S"), (33, "x" * 3_000), (None, "text without an id"), (34, "  leading and trailing  ")]
    rows += [(35, "\x00 nul\x00 inside , \x00"), (36, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (37, "1 22 333 4444 55555")]
    return rows
