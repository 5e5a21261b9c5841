import re

import pytest
from llm_tables import frame, prose

from driftline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, size=10):
    out = []
    for doc_id, text in rows:
        w, hit, met = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    met.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(met)))
    return out


@pytest.fixture(scope="module")
def benchmark_rows(awkward):
    base = awkward[0][1].split(" ")
    return [
        (100, " ".join(base[5:40])), (9, "x " + " ".join(base[30:39]) + " y"), (30, "Two"), (31, "one TWO"), (30, " ".join(base[60:75])),
        (40, None), (41, " ;; "), (42, "shti " * 12), (43, " ".join(base[:9])), (44, "É x"), (45, prose(77, 40)),
    ]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, n_words long")


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_hits_equal_brute_force(spark, awkward, benchmark_rows, broadcast_rows):
    rows = [*awkward, (50, prose(77, 12) + " a " + prose(77, 9)), (51, "A-b " + prose(77, 40).upper())]
    got = decontaminate.contamination(frame(spark, rows), items(spark, benchmark_rows), broadcast_rows=broadcast_rows).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(map(str, brute(rows, benchmark_rows)))


def test_other_windows(spark, awkward, benchmark_rows):
    for window in (1, 3, 7):
        got = decontaminate.contamination(frame(spark, awkward), items(spark, benchmark_rows), window=window).collect()
        want = brute(awkward, benchmark_rows, window)
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(map(str, want))


def test_filter_keeps_columns_and_clean_rows(spark, awkward, benchmark_rows):
    docs = frame(spark, awkward)
    kept = decontaminate.without_contaminated(docs, items(spark, benchmark_rows))
    assert kept.columns == docs.columns
    want = [doc_id for (doc_id, _), (_, _, n_hit, _) in zip(awkward, brute(awkward, benchmark_rows), strict=True) if not n_hit]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.select("doc_id").collect())


def test_empty_tables(spark, awkward, benchmark_rows):
    assert decontaminate.contamination(frame(spark, []), items(spark, benchmark_rows)).count() == 0
    got = decontaminate.contamination(frame(spark, awkward), items(spark, [])).collect()
    assert len(got) == len(awkward) and not any(r.n_hit or r["items"] for r in got)
    assert decontaminate.without_contaminated(frame(spark, awkward), items(spark, [])).count() == len(awkward)


