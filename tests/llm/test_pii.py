import random
import re
from collections import Counter

import pytest
from llm_tables import frame, prose

from driftline.llm import pii

PATTERNS = [
    re.compile(p) for p in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
]


def brute(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = (
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, 9 <= len(digits) <= 15,
            )[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    alphabet = "a1@.+-% ()x9\né0"
    for _ in range(4_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), repr(text)
    for text in (
        "x a.b+c@d-e.fr.. y@z@k.l 4111 1111 1111 1111, 10.0.0.256 1.2.3.4.5.6.7.8 +1 (974) 555-3436 +44 20 7946 0958-",
        "é" * 70 + "a" * 200 + "@" + "b" * 300 + ".c" + " 000000000001.2.3.4", "4111-1111-1111-1111 4111  1111",
    ):
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "@" * 50_000, "1." * 200_000, "+1" * 100_000, "a@" * 100_000, "+1" + "(" * 200_000):
        pii.base_spans(text)
    for text in ("1 " * 200_000, "a1 " * 100_000, "x at " * 100_000 + "dot", "a at b" + " dot b" * 100_000, "((((" * 50_000 + "1 dot"):
        list(pii.candidates(text, pii.Settings()))


def test_patterns_discover_unseen_identifiers(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"{prose(i, 12)} reach me at user{i}x@mail{i}.example.com now {prose(200 + i, 8)}"))
    rows.append((100, f"{prose(900, 9)} reach me at clerk7734(at)firm-example now {prose(901, 5)}"))
    rows.append((101, f"{prose(902, 9)} code7734x {prose(903, 5)}"))
    rows += [(200 + i, f"{prose(300 + i, 5)} number 55{i}31z7 {prose(400 + i, 5)}") for i in range(9)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert all(len(got[i].base) == 1 and not got[i].found for i in range(30))
    assert [(s.kind, texts[100][s.start:s.end]) for s in got[100].found] == [(0, "clerk7734(at)firm-example")]
    assert not any(got[i].found or got[i].base for i in (101, *range(200, 209)))


def test_identifiers_of_several_tokens_are_found(spark):
    """Numbers in groups without a plus, and spelt addresses, in the contexts of sure ones."""
    rows = [(i, f"{prose(i, 12)} call us on +44 20 7946 {1000 + i} or later {prose(500 + i, 6)}") for i in range(40)]
    rows += [(100 + i, f"{prose(100 + i, 12)} write to us under user{i}x@mail{i}.example.org and wait {prose(600 + i, 6)}") for i in range(40)]
    numbers = {200 + i: f"020 7946 {4000 + i}" for i in range(10)} | {220 + i: f"(020) 7946-{5000 + i}" for i in range(5)}
    spelt = {300 + i: f"user{i} at host{i} dot org" for i in range(10)} | {320 + i: f"first.last{i} (at) firm [dot] co [dot] uk" for i in range(5)}
    rows += [(i, f"{prose(i, 12)} call us on {x}, or later {prose(700 + i, 6)}") for i, x in numbers.items()]
    rows += [(i, f"{prose(i, 12)} write to us under {x} and wait {prose(800 + i, 6)}") for i, x in spelt.items()]
    clean = {400 + i: f"{prose(i, 12)} the year was {1900 + i} and {i} more 12 of 34567 at home dot {prose(900 + i, 6)}" for i in range(40)}
    rows += list(clean.items())
    texts = dict(rows)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.found] for r in pii.personal_data(frame(spark, rows)).collect()}
    want = {i: [(3, x)] for i, x in numbers.items()} | {i: [(0, x)] for i, x in spelt.items()}
    assert {i: found for i, found in got.items() if found} == want


def test_runs_and_contexts():
    settings = pii.Settings()
    for text, runs in (
        ("a 020 7946 0958 b", ["020 7946 0958"]), ("12 34", []), ("12 3456", ["12 3456"]), ("x1 020  7946 0958", ["7946 0958"]),
        ("1234567, 7654321", ["1234567", "7654321"]), ("code7734x 123 456", ["code7734x", "123 456"]),
        ("me at host dot org 123456 7", ["me at host dot org", "123456 7"]), ("at dot at dot", []), ("", []),
    ):
        assert [text[a:b] for a, b in pii.candidates(text, settings)] == runs, text
    assert pii.words_before("w" * 1000 + " " + "x" * 900 + "   9", 1904, 2) == ["w" * 1000, "x" * 900]
    assert pii.word_after("9 " + " " * 900 + "y" * 700 + " z", 1) == "y" * 700 and pii.word_after("9", 1) == ""


def test_scores_of_the_graph_equal_plain_ones(spark):
    rng = random.Random(7)
    edges = set()
    for name in range(160):
        kind, like = rng.choice([None, None, 0, 3]), rng.choice([0, 1, 8, 9])
        for _ in range(rng.randint(1, 3)):
            edges.add((rng.randint(0, 3) if kind is None else (kind == 3) * 2 + rng.randint(0, 1), name, kind, 0 if kind is not None else like))
    settings = pii.Settings(trusted=0.66, support=3)
    supported = {}
    for p, k in {(p, k) for p, _, k, _ in edges if k is not None}:
        own = [(kind, like) for q, _, kind, like in edges if q == p]
        seeds = sum(kind == k for kind, _ in own)
        if seeds >= settings.support:
            supported[p, k] = seeds, sum(kind != k if kind is not None else not like >> k & 1 for kind, like in own)
    unknown = {(p, n, like) for p, n, k, like in edges if k is None and any(p == q for q, _ in supported)}
    gained, history = Counter(), []
    for _ in range(settings.rounds + 1):
        scores = {pk: (s + gained[pk]) / (s + gained[pk] + against) for pk, (s, against) in supported.items()}
        trusted = {pk: score for pk, score in scores.items() if score >= settings.trusted}
        history.append(trusted)
        doubt = {}
        for p, n, like in unknown:
            for (q, k), score in trusted.items():
                if p == q and like >> k & 1:
                    doubt[n, k] = doubt.get((n, k), 1.0) * (1 - min(score, 0.999))
        gained = Counter()
        for p, n, _ in unknown:
            for (m, k), d in doubt.items():
                if n == m and (p, k) in supported:
                    gained[p, k] += 1 - d
    got = pii.trusted_patterns(spark.createDataFrame(sorted(edges, key=str), "pattern long, name long, kind int, like int"), settings)
    assert {(r.pattern, r.kind): r.score for r in got.collect()} == pytest.approx(trusted)
    assert trusted.keys() < supported.keys() and any(trusted[x] > history[0][x] for x in trusted)


def test_awkward_rows(spark, awkward):
    got = pii.personal_data(frame(spark, awkward)).collect()
    assert len(got) == len(awkward) and not any(r.base or r.found for r in got)
    assert pii.personal_data(frame(spark, [])).count() == 0
