import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import frame
from tokenizers import Tokenizer

from driftline.llm import bpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LIBRARY = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
ODD = [
    "", " ", "a", "don't it's WE'LL 'tis ''s", "<|endoftext|> a<|startoftext|>b<|endoftext|><|endoftext|>", "İ ſ ́x ΑΣ ΣΑΣ.", "a b c\x85d 中文 ١٢٣ 1234",
    "é é  ﬁ K Å", "x" * 3000, "ab" * 2500, "\t\n\x0b\x0c\r \x1c\x1f", "😀👩‍👩‍👧 emoji", "�​ y　z", "<|endof text|>", "a\x00b", "Ǆ ŉ ẞ ǰ",
]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    return bpe.Coder(definition), bpe.Names(definition), Tokenizer.from_file(path)


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), dtype="<u4").tolist()


def test_odd_texts(both):
    coder, names, library = both
    for text in ODD:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(coder, text) == want, text
        assert names.decode(np.array(want, dtype="<u4").tobytes()) == library.decode(want, skip_special_tokens=False), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    coder, names = bpe.loaded(bpe.Coder, definition), bpe.loaded(bpe.Names, definition)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(coder, text) == want
    assert names.decode(np.array(want, dtype="<u4").tobytes()) == LIBRARY.decode(want, skip_special_tokens=False)


def plain_merges(names, merges, piece):
    """Repeatedly the leftmost merge of the least rank."""
    symbols = [c for c in piece if c in names]
    while True:
        found = [(merges.index([a, b]), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if [a, b] in merges]
        if not found:
            return [names.index(s) for s in symbols]
        _, i = min(found)
        symbols[i:i + 2] = ["".join(symbols[i:i + 2])]


def test_queue_equals_plain_merging():
    rng = random.Random(2)
    names, merges = [*"abc"], []
    for _ in range(25):
        left, right = rng.choice(names), rng.choice(names)
        if left + right not in names:
            names.append(left + right)
            merges.append([left, right])
    known = bpe.Merges({"vocab": {n: i for i, n in enumerate(names)}, "merges": merges})
    for _ in range(500):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        assert known.merged(piece) == plain_merges(names, merges, piece)


def test_long_piece_in_little_time():
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        merges = bpe.loaded(bpe.Coder, file.read()).merges
    started = time.perf_counter()
    assert merges.merged("a" * 200_000)
    assert time.perf_counter() - started < 20


def test_parts_of_long_texts(monkeypatch):
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        coder = bpe.Coder(file.read())
    text = " some words\tand more\n" * 50 + "x" * 400 + " end"
    whole = coder.encode(text)
    monkeypatch.setattr(bpe, "CHARACTERS_AT_ONCE", 37)
    assert coder.encode(text) == whole and "".join(bpe.slices(text)) == text


@pytest.mark.parametrize("name", FILES)
def test_tables(spark, awkward, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = [*awkward, *[(100 + i, t) for i, t in enumerate(ODD)]]
    coded = bpe.decode(bpe.encode(frame(spark, rows), path), path)
    got = sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in coded.collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_query(spark, awkward, tmp_path):
    from driftline.llm.queries import REGISTRY

    frame(spark, awkward).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in REGISTRY["op12_bpe_codec"](spark, str(tmp_path)).collect()}
    assert len(got) == len({i for i, _ in awkward})
    ids = LIBRARY.encode("One Two", add_special_tokens=False).ids
    row = got[7]
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_tables_and_null_ids(spark):
    assert bpe.decode(bpe.encode(frame(spark, []))).count() == 0
    ids = spark.createDataFrame([(1, None, "old"), (2, bytearray(), "old")], "k int, ids binary, decoded string")
    assert {r["decoded"] for r in bpe.decode(ids).collect()} == {""}


def test_foreign_rules_are_refused():
    with pytest.raises(ValueError, match="plain byte-pair"):
        bpe.Merges({"type": "WordPiece", "vocab": {}, "merges": []})
    with pytest.raises(ValueError, match="plain byte-pair"):
        bpe.Merges({"vocab": {}, "merges": [], "byte_fallback": True})
