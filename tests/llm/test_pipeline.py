"""The pipeline on a small corpus against a plain version of each stage, and the SQL twins of the queries."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from llm_tables import prose
from tokenizers import Tokenizer

from driftline.llm import mixing, simhash, tokenfiles
from driftline.llm.queries import REGISTRY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    benchmark = [(i, prose(9_000 + i, 30)) for i in range(4)]
    rows, labels = [], []
    for i in range(90):
        text = prose(i, 60 + i % 40)
        if i % 9 == 0:
            text = text.replace(" ", " vilewort ", 3)
        if i % 10 == 3:
            text += " " + benchmark[i % 4][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(200 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(10)]
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{top}/{name}.parquet")
    write("documents", rows, COLUMNS)
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", benchmark, "item_id long, text string")
    return str(top), rows, benchmark


def test_stages_and_result(spark, folder):
    top, rows, benchmark = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, top)
        docs = spark.createDataFrame(found.collect(), found.schema)
        by_stage[name] = docs.collect()
        if name != "token_records":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: [r.doc_id for r in found] for name, found in by_stage.items()}
    text = {r[0]: r[1] for r in rows}
    assert sorted(ids["toxicity"]) == sorted(i for i in text if "vilewort" not in (text[i] or ""))
    prints = {i: simhash.fingerprint((text[i] or "").encode()) for i in ids["toxicity"]}
    left = [i for i in sorted(prints) if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in prints)]
    assert sorted(ids["simhash_near_dedup"]) == left
    grams = {g for _, t in benchmark for w in [t.split()] for g in zip(*(w[k:] for k in range(10)), strict=False)}
    clean = lambda t: not grams & set(zip(*((t or "").split()[k:] for k in range(10)), strict=False))
    assert sorted(ids["decontamination"]) == [i for i in left if clean(text[i])]
    words = Counter()
    for r in by_stage["mixing"]:
        words[r.doc_id] += len(r.text.split())
    kept = spark.createDataFrame([r for r in by_stage["decontamination"]], COLUMNS)
    assert words == +Counter({r.doc_id: r.taken for r in mixing.mix(kept).collect()})
    tokenizer, want, start = Tokenizer.from_file(tokenfiles.default_tokenizer()), [], 0
    for r in sorted(by_stage["mixing"], key=lambda r: (r.doc_id, r.text.encode())):
        own = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, by_stage["token_records"])) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, top).collect())) == sorted(want)


def test_one_query_for_each_operator():
    assert {name.split("_")[0] for name in REGISTRY} == {f"op{n}" for n in range(1, 11)} and len(REGISTRY) == 10
