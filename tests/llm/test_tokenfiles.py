import weakref
import zlib

import numpy as np
import pytest
from llm_tables import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import tokenfiles
from driftline.llm.shared import worker_cache


def test_round_trip(spark, awkward, tmp_path):
    rows = [*awkward, (-5, "<|endoftext|> a<|startoftext|>b  İ ſ ́x"), (60, "a b c\x85d 中文 ١٢٣ don't it's")]
    tokenizer = Tokenizer.from_file(tokenfiles.default_tokenizer())
    ids = [(i, t, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want, start = [], 0
    for doc_id, _, own in ids:
        want.append((doc_id, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    files = tokenfiles.write_tokens(frame(spark, rows), folder=str(tmp_path / "out"))
    got = [tuple(r) for r in tokenfiles.read_tokens(files).orderBy("start").collect()]
    assert got == want
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    assert not list((tmp_path / "out").glob(".attempt*"))


def test_damage_is_seen(spark, tmp_path):
    files = tokenfiles.write_tokens(frame(spark, [(1, "some words"), (2, "more of them")]), folder=str(tmp_path / "out"))
    path = next((tmp_path / "out").glob("*.records"))
    data = bytearray(path.read_bytes())
    data[15] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        tokenfiles.read_tokens(files).collect()


def test_long_text_is_cut_at_words():
    with open(tokenfiles.default_tokenizer(), encoding="utf-8") as file:
        encoder = tokenfiles.WordEncoder(file.read())
    text = b"alpha beta gamma delta " * 60_000
    whole, short = encoder.encode(iter([text, b"alpha"]), 2)
    assert len(whole) == 240_000 // 4 * len(encoder.of_words(text[:23].split())[0]) + 1
    assert list(short) == [*encoder.of_words([b"alpha"])[0], 2]


def test_empty_table(spark):
    assert tokenfiles.token_records(frame(spark, [])).count() == 0


def test_tokenizers_that_keep_blanks_encode_whole_texts(spark, awkward):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*awkward, (70, "  two  blanks\n and a line\t"), (71, "a <|endoftext|> b")]
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for _, t in rows)
    got = sorted(r.ids_crc32 for r in tokenfiles.token_records(frame(spark, rows), path).collect())
    assert got == want


def test_runs_of_an_encoder_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED_RUNS", 1_000, raising=False)
    with open(tokenfiles.default_tokenizer(), encoding="utf-8") as file:
        encoder = tokenfiles.WordEncoder(file.read())
    letters = "abcdefghij"
    for nth in range(40):
        words = ["".join(letters[int(c)] for c in str(nth * 100 + i)) for i in range(100)]
        text = [f"{word},{word}k;{word}l".encode() for word in words]
        got, lengths = encoder.of_words(text)
        assert got.tolist() == encoder.tokenizer.encode(b" ".join(text).decode(), add_special_tokens=False).ids and len(lengths) == 100
        assert len(encoder.runs) <= 1_000 + 5 * 100


def test_a_worker_keeps_the_encoder_for_tasks_of_this_operator_only():
    with open(tokenfiles.default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    encoder = tokenfiles._encoder(definition)
    assert tokenfiles._encoder(definition) is encoder
    kept = weakref.ref(encoder)
    del encoder
    worker_cache("toxicity")
    assert kept() is None
