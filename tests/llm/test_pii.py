import hashlib
import random
import re

import pytest
from samples import texts

from grove.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_base_equals_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.co", "@", "x_1@y-2.z.w", "1.2.3.4", "300.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", ".", "-", " ", "12", "é", "+", "a.b"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a." * 100_000 + "@", "@" * 200_000, "1 " * 100_000, "+1" * 100_000, "1." * 100_000):
        pii.base_spans(text)


def document_rows(spark):
    numbers = [f"{i:03d}-{i * 7 % 1000:03d}-{i * 13 % 10000:04d}" for i in range(60)]
    known = [(i, f"please call hotline +1 {n} today, thanks number {i}") for i, n in enumerate(numbers[:40])]
    unseen = [(100 + i, f"please call hotline {n} today or write") for i, n in enumerate(numbers[40:50])]
    stray = [(200 + i, f"the ledger {i} shows {n} among the others the others the others") for i, n in enumerate(numbers[50:])]
    return known, unseen, stray


def test_contexts_find_unseen_identifiers(spark):
    known, unseen, stray = document_rows(spark)
    rows = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(known + unseen + stray, "doc_id long, text string")).collect()}
    assert all(rows[i].n_phone == 1 for i, _ in known)
    assert all(rows[i].n_added == 1 and rows[i].spans.startswith("phone:20:") and rows[i].n_phone == 0 for i, _ in unseen)
    assert all(rows[i].n_added == 0 and rows[i].spans == "" for i, _ in stray)


def test_columns_against_brute_force(docs):
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_pii(docs).collect())
    want = []
    for i, t in texts():
        spans = brute(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *(sum(k == j for k, _, _ in spans) for j in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("text, added", [("user (at) mail (dot) org", 1), ("fe80:0:0:1::", 0), ("fe80:1:2:3:4", 1), ("1234 5678 9012 3456", 1), ("555-0100-200", 1), ("1234", 0), ("v1.2.3456789", 0)])
def test_what_looks_like_an_identifier(text, added):
    assert len(pii.likely_spans(text, pii.base_spans(text))) == added


def test_empty(no_docs):
    assert pii.find_pii(no_docs).count() == 0


@pytest.mark.parametrize("label", ["tel:", "<"])
def test_glued_contexts_find_unseen_identifiers(spark, label):
    """Labels that never stand alone; a full stop, which ends all sentences, tells nothing."""
    numbers = [f"{i:03d}-{i * 7 % 1000:03d}-{i * 13 % 10000:04d}" for i in range(80)]
    rows = [(i, f"line {label}+1 {n} or. So it is. And on. And on.") for i, n in enumerate(numbers[:60])]
    unseen = [(100 + i, f"line {label}{n} and") for i, n in enumerate(numbers[60:70])]
    stray = [(200 + i, f"the ledger has #{n}. So it is. And on.") for i, n in enumerate(numbers[70:])]
    more = [(300 + i, f"reach +1 {n}. So it is. And on. And on.") for i, n in enumerate(numbers[:60])]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows + unseen + stray + more, "doc_id long, text string")).collect()}
    assert all(got[i].n_phone == 1 for i, *_ in rows + more)
    assert all(got[i].n_added == 1 for i, _ in unseen)
    assert all(got[i].n_added == 0 and got[i].spans == "" for i, _ in stray)


def test_a_label_glued_to_other_words_too_tells_little(spark):
    numbers = [f"{i:03d}-{i * 7 % 1000:03d}-{i * 13 % 10000:04d}" for i in range(50)]
    rows = [(i, f"line <+1 {n} {i}x <and <so <on") for i, n in enumerate(numbers[:40])] + [(100 + i, f"sum <{n} y{i}") for i, n in enumerate(numbers[40:])]
    assert all(r.n_added == 0 for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_contexts_are_whole_words():
    from grove.llm.pii import _contexts

    long = "w" * 1_000
    text = f"first {long}{' ' * 200}SPAN{' ' * 300}{long}9 last"
    at = text.index("SPAN")
    assert _contexts(text, at, at + 4) == (long, long + "0")
    assert _contexts("SPAN", 0, 4) == (None, None) and _contexts("  SPAN ", 2, 6) == (None, None)
    assert _contexts("a Tel:SPAN, b", 6, 10) == ("tel:", ",")
