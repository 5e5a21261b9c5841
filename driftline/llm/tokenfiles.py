"""Token ids in length-delimited binary files with an offset index.

Documents are dealt into ranges of doc_id, one file per range, so the files in
their order hold all documents by ascending doc_id. A task tokenizes its range
and writes it in one go; no ids are shuffled.

Data file, one record per document:
    length   uint64   bytes of the payload
    check    uint32   masked CRC-32 of the length's eight bytes
    payload           ids, little-endian uint16 (vocabulary of up to 65,536) or uint32
    check    uint32   masked CRC-32 of the payload
Index file, one entry per record, for reads in any order:
    offset uint64, doc_id int64, ids before it in the file uint64, ids uint32, flags uint32 (1: doc_id is null)

A mask as in TFRecord files keeps checksums of data that holds checksums sound.
A task writes under a name of its own and renames at the end; a repeated task
replaces the file by an equal one.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.shared import ready, stored, text_bytes, worker_cache
from driftline.session import shared_folder

END_ID = 2
HEAD, CHECK, ENTRY = "<QI", "<I", "<QqQII"
HEAD_BYTES, CHECK_BYTES, ENTRY_BYTES = 12, 4, 32
MASK = 0xA282EAD8
WORDS_AT_ONCE = 200_000
CACHED_WORDS, CACHED_RUNS = 800_000, 100_000  # of a worker, which keeps them between tasks of this operator
RECORDS_PER_READ = 2_000
INDEX_TYPE = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("before", "<u8"), ("n", "<u4"), ("flags", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Words of Latin letters and plain marks: the pattern below cuts them as the tokenizer does, into runs of either.
SIMPLE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e.,;:!?#*$%&|()\[\]{}\"/+=_@>~^-]+")
RUN = re.compile(r"[a-z\u00df-\u017e]+|[^a-z\u00df-\u017e]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


# Normalisers that change each word on its own, and a pattern whose pieces hold no white space.
BY_WORD = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}
NO_BLANKS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def drops_blanks(rules: dict) -> bool:
    """Whether the ids of a text are those of its words, one after the other: white space ends pieces and leaves none."""
    normal = rules.get("normalizer") or {}
    by_word = all(
        x["type"] in BY_WORD and (x["type"] != "Replace" or (x["pattern"].get("Regex"), x["content"]) == ("\\s+", " "))
        for x in normal.get("normalizers", [normal] if normal else [])
    )
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split, after = (cuts[0], cuts[1]) if len(cuts) == 2 else ({}, {})
    plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in rules.get("added_tokens") or [])
    return (
        by_word and plain and after.get("type") == "ByteLevel" and not after.get("add_prefix_space") and not after.get("use_regex")
        and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"
        and split["pattern"].get("Regex") == NO_BLANKS
    )


class WordEncoder:
    """Ids of texts, word by word with a bounded cache.

    Only tokenizers that split at white space and drop it (``drops_blanks``)
    have a text's ids as those of its words, one after the other; with all
    others whole texts are encoded. Simple words, in lower
    case, go to the tokenizer's model run by run, if the tokenizer's rules are
    the ones known here; all others go through the whole tokenizer.
    """

    KNOWN_RULES = (  # fixed values: the rules for which runs of simple words are known
        ("NFC", "Replace", "Lowercase"), NO_BLANKS,
    )

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        rules = json.loads(definition)
        steps = tuple(x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", []))
        cuts = [x.get("pattern", {}).get("Regex") for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = drops_blanks(rules)
        self.by_runs = (steps, cuts[0] if cuts else None) == self.KNOWN_RULES
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.runs: dict[str, bytes] = {}
        self.lengths, self.starts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.kind)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _run(self, run: str) -> bytes:
        mapped = run if run.isascii() else "".join(map(self.alphabet.__getitem__, run.encode()))
        found = self.runs[run] = self._packed([token.id for token in self.tokenizer.model.tokenize(mapped)])
        return found

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words, packed, so that the cache is few objects."""
        packed, others = [b""] * len(words), []
        known, simple, cut = self.runs.get, SIMPLE.fullmatch, RUN.findall
        for nth, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            if self.by_runs and simple(text):
                runs = cut(text.lower())
                if len(runs) == 1:
                    packed[nth] = known(runs[0]) or self._run(runs[0])
                else:
                    packed[nth] = b"".join([known(run) or self._run(run) for run in runs])
            else:
                others.append((nth, text))
        found = self.tokenizer.encode_batch([text for _, text in others], add_special_tokens=False)
        for (nth, _), own in zip(others, found, strict=True):
            packed[nth] = self._packed(own.ids)
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.kind.itemsize
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(packed), dtype=self.kind)))

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        if len(self.place) > CACHED_WORDS:
            self.forget()
        if len(self.runs) > CACHED_RUNS:
            self.runs.clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list({words[i] for i in missing}))
            at[missing] = [self.place[words[i]] for i in missing]
        lengths = self.lengths[at]
        nth = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.ids[np.repeat(self.starts[at], lengths) + nth], lengths

    def encode(self, texts: Iterator[bytes], end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text with the end id; small texts share a call, large ones take several."""
        if not self.by_word:
            for text in texts:
                ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
                yield np.array([*ids, end_id], dtype=self.kind)
            return
        waiting: list[list[bytes]] = []

        def flush() -> Iterator[np.ndarray]:
            ids, lengths = self.of_words([w for words in waiting for w in words])
            per_text = np.cumsum([len(words) for words in waiting])
            ends = np.concatenate(([0], np.cumsum(lengths)))[per_text]
            for part in np.split(ids, ends[:-1]):
                yield np.append(part, self.kind.type(end_id))
            waiting.clear()

        held = 0
        for text in texts:
            words = text.split()  # of bytes: at ASCII white space only
            if len(words) > WORDS_AT_ONCE:
                if waiting:
                    yield from flush()
                parts = [self.of_words(words[i:i + WORDS_AT_ONCE])[0] for i in range(0, len(words), WORDS_AT_ONCE)]
                yield np.concatenate([*parts, np.array([end_id], dtype=self.kind)])
                held = 0
                continue
            waiting.append(words)
            held += len(words)
            if held >= WORDS_AT_ONCE:
                yield from flush()
                held = 0
        if waiting:
            yield from flush()


def _encoder(definition: str) -> WordEncoder:
    key, encoders = zlib.crc32(definition.encode()), worker_cache("tokenfiles")
    if key not in encoders:
        encoders[key] = WordEncoder(definition)
    return encoders[key]


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all texts and return the files: file, shard, records, tokens, bytes, width of an id.

    ``tokenizer`` is the path of a tokenizers file. Null texts are empty and
    hold the end id alone. Rows without doc_id come first; rows that repeat a
    doc_id stand together, by text. An empty table writes no file.
    """
    spark = ready(docs)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())  # a vocabulary, independent of the corpus
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, top = pyarrow.fs.FileSystem.from_uri(folder)
        path, own = f"{top}/part-{shard:07d}", f"{top}/.attempt-{attempt}-{shard:07d}"
        encoder, names, index = _encoder(definition.value), [], []

        def texts() -> Iterator[bytes]:
            for batch in batches:
                names.extend(batch.column("doc_id").to_pylist())
                yield from (x.as_py() for x in batch.column("text"))

        data, offset, before, entries = None, 0, 0, 0
        for ids in encoder.encode(texts(), end_id):
            if data is None:
                files.create_dir(top, recursive=True)
                data, index = files.open_output_stream(f"{own}.records"), files.open_output_stream(f"{own}.index")
            payload = ids.tobytes()
            size = struct.pack("<Q", len(payload))
            data.write(struct.pack(HEAD, len(payload), masked(size)))
            data.write(payload)
            data.write(struct.pack(CHECK, masked(payload)))
            name = names[entries]
            index.write(struct.pack(ENTRY, offset, 0 if name is None else name, before, len(ids), int(name is None)))
            offset += HEAD_BYTES + len(payload) + CHECK_BYTES
            before += len(ids)
            entries += 1
        if data is None:
            return
        for stream, kind in ((data, "records"), (index, "index")):
            stream.close()
            files.move(f"{own}.{kind}", f"{path}.{kind}")
        yield pa.RecordBatch.from_pydict({
            "file": [path], "shard": pa.array([shard], pa.int64()), "records": pa.array([entries], pa.int64()),
            "tokens": pa.array([before], pa.int64()), "bytes": pa.array([offset], pa.int64()), "width": pa.array([encoder.kind.itemsize], pa.int32()),
        })

    by_range = docs.select("doc_id", text_bytes().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = by_range.mapInArrow(write, "file string, shard long, records long, tokens long, bytes long, width int")
    return stored(files.withColumn("folder", F.lit(folder)))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read back and checked.

    A task seeks the records of a few index entries, in no need of their order.
    ``start`` counts the ids of all files before (one running sum over files)
    and of the records before in the file (from the index). Records of null and
    empty texts hold the end id alone, those without doc_id have a null one;
    repeated rows have a record each; no files give no rows. A damaged record raises.
    """
    spark = ready(files)
    bases = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("tokens").over(bases), F.lit(0)))
    reads = based.withColumn("first", F.explode(F.expr(f"sequence(0L, records - 1, {RECORDS_PER_READ}L)")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = pyarrow.fs.FileSystem.from_uri(row["folder"])
                n = min(RECORDS_PER_READ, row["records"] - row["first"])
                with system.open_input_file(f"{row['file']}.index") as index:
                    entries = np.frombuffer(index.read_at(n * ENTRY_BYTES, row["first"] * ENTRY_BYTES), dtype=INDEX_TYPE)
                checks = []
                with system.open_input_file(f"{row['file']}.records") as data:
                    for offset, count in zip(entries["offset"].tolist(), entries["n"].tolist(), strict=True):
                        size = count * row["width"]
                        record = data.read_at(HEAD_BYTES + size + CHECK_BYTES, offset)
                        length, head_check = struct.unpack_from(HEAD, record)
                        payload = record[HEAD_BYTES:HEAD_BYTES + size]
                        if length != size or head_check != masked(record[:8]) or masked(payload) != struct.unpack_from(CHECK, record, HEAD_BYTES + size)[0]:
                            raise ValueError(f"damaged record at {offset} of {row['file']}")
                        checks.append(zlib.crc32(np.frombuffer(payload, dtype=f"<u{row['width']}").astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(entries["doc_id"], mask=entries["flags"] == 1),
                    "start": pa.array(entries["before"].astype(np.int64) + row["base"]),
                    "n_tokens": pa.array(entries["n"].astype(np.int64)), "ids_crc32": pa.array(checks, pa.int64()),
                })

    return reads.repartition(parts, "file", "first").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_records(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the texts' ids and read the files back; see both functions."""
    return read_tokens(write_tokens(docs, tokenizer, end_id))
