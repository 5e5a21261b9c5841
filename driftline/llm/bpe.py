"""Byte-pair encoding by a priority queue of merges over a linked list of symbols, and decoding.

The symbols of a piece stand in a doubly linked list. A heap holds the merges
of neighbouring symbols by rank, then by place; a merge that is popped after
one of its symbols has gone is stale and skipped. A piece of n symbols takes
O(n log n) steps, whatever its length.

What a piece is (normal form, cuts, special tokens) is said by the tokenizer's
file and done by the tokenizers library's own rules; ids come from the queue.
Pieces recur, so a worker remembers the ids of words or pieces it has met, up
to a bound, and forgets them all beyond it. Decoding puts the vocabulary's strings
of all ids one after the other and applies the file's decoder.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.shared import ready, text_bytes
from driftline.llm.tokenfiles import RUN, SIMPLE, byte_alphabet, drops_blanks

REMEMBERED, LONGEST_REMEMBERED = 100_000, 100  # words, and as many pieces; and characters of one
CHARACTERS_AT_ONCE = 1 << 20
OUTPUT_BYTES = 4 << 20
ID_BITS, PLACE_BITS = 20, 40
RANK_SHIFT, ID_MASK, PLACE_MASK = ID_BITS + PLACE_BITS, (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1
BLANK = re.compile(r"[\x20\x09-\x0D]")
ALPHABET = byte_alphabet()
words_of = re.compile(r"[\x20\x09-\x0D]+").split


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """A BPE vocabulary with its ranked merges."""

    def __init__(self, model: dict) -> None:
        unknown = [k for k in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or unknown:
            raise ValueError(f"not a plain byte-pair vocabulary: {model.get('type')}, {unknown}")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if max(self.ids.values(), default=0) >> ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        # A pair of ids in one number, and a merge's rank and new id in one: numbers are quicker to hash and to compare than tuples.
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[self.ids[left] << ID_BITS | self.ids[right]] = rank << RANK_SHIFT | self.ids[left + right]
        self.first = {c: i for c, i in self.ids.items() if len(c) == 1}
        ends = len(self.suffix)
        self.last = {c[:1]: i for c, i in self.ids.items() if len(c) == 1 + ends and c.endswith(self.suffix)}

    def merged(self, piece: str) -> list[int]:
        """Ids of a piece; characters that are not in the vocabulary are left out."""
        first, last = self.first, self.last
        symbols = [first[c] for c in piece[:-1] if c in first]
        symbols += [last[c] for c in piece[-1:] if c in last]
        size = len(symbols)
        if size < 2:
            return symbols
        found_of = self.pairs.get
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        # An entry: rank, place and new id of a merge, in this order of weight.
        queue = [
            found + (place << ID_BITS) for place in range(size - 1)
            if (found := found_of(symbols[place] << ID_BITS | symbols[place + 1])) is not None
        ]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            new, place = entry & ID_MASK, entry >> ID_BITS & PLACE_MASK
            left, right = symbols[place], after[place]
            if left < 0 or right < 0:
                continue  # stale: the symbol has gone, or has no neighbour any more
            found = found_of(left << ID_BITS | symbols[right])
            if found is None or found & ID_MASK != new:
                continue  # stale: another merge has changed one of the two
            symbols[place], symbols[right] = new, -1
            after[place] = right = after[right]
            if right >= 0:
                before[right] = place
                if (found := found_of(new << ID_BITS | symbols[right])) is not None:
                    heappush(queue, found + (place << ID_BITS))
            if (left := before[place]) >= 0 and (found := found_of(symbols[left] << ID_BITS | new)) is not None:
                heappush(queue, found + (left << ID_BITS))
        return [s for s in symbols if s >= 0]


class Remembered(dict):
    """The last entries that were met, two generations of at most ``REMEMBERED`` each; what recurs is never forgotten for long."""

    before: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value

    def old(self, key: str) -> bytes | None:
        """An entry of the generation before, now in this one."""
        found = self.before.get(key)
        return None if found is None else self.put(key, found)


class Coder:
    """Texts to ids by the rules of one tokenizers file.

    Files whose special tokens are found after normalising, or with white space
    around them, and vocabularies other than plain BPE are refused.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.merges = Merges(rules["model"])
        added = rules.get("added_tokens") or []
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens with rules of their own are not known here")
        self.special = special_tokens(rules)
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if added else None
        self.drops_blanks = drops_blanks(rules)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.by_runs = self.drops_blanks and steps == ["NFC", "Replace", "Lowercase"]
        self.known, self.pieces = Remembered(), Remembered()

    def _pieces(self, text: str) -> Iterator[str]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        if not text:
            return
        if self.library.pre_tokenizer is None:
            yield text
            return
        yield from (piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece."""
        return self.pieces.old(piece) or self.pieces.put(piece, array("I", self.merges.merged(piece)).tobytes())

    def _plain(self, text: str) -> Iterator[bytes]:
        known = self.pieces.get
        for piece in self._pieces(text):
            found = known(piece)
            yield self._piece(piece) if found is None else found

    def _packed(self, text: str) -> bytes:
        """Ids of a text with its special tokens, which are found as they stand."""
        parts, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            parts += self._plain(text[at:found.start()])
            parts.append(array("I", [self.special[found.group()]]).tobytes())
            at = found.end()
        parts += self._plain(text[at:])
        return b"".join(parts)

    def _word(self, word: str) -> bytes:
        """Ids of a word, for ``encode`` to look up."""
        if (found := self.known.old(word)) is not None:
            return found
        if self.by_runs and SIMPLE.fullmatch(word) and "<|" not in word:
            known, parts = self.pieces.get, []
            for run in RUN.findall(word.lower()):
                if not run.isascii():
                    run = "".join(map(ALPHABET.__getitem__, run.encode()))
                found = known(run)
                parts.append(self._piece(run) if found is None else found)
            packed = b"".join(parts)
        else:
            packed = self._packed(word)
        return self.known.put(word, packed)

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        if not self.drops_blanks:
            return self._packed(text)
        known, parts = self.known.get, []
        for part in slices(text):
            for word in words_of(part):
                if word:
                    found = known(word)
                    parts.append(self._word(word) if found is None else found)
        return b"".join(parts)

    def encode_bytes(self, text: bytes) -> bytes:
        return self.encode(text.decode("utf-8", "replace"))


def special_tokens(rules: dict) -> dict[str, int]:
    return {x["content"]: x["id"] for x in rules.get("added_tokens") or []}


class Names:
    """Ids back to text; without the merges, so that a decoding worker is small."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        rules = json.loads(definition)
        known = rules["model"]["vocab"] | special_tokens(rules)
        self.names = [""] * (1 + max(known.values(), default=0))
        for name, number in known.items():
            self.names[number] = name
        # A tokenizer without vocabulary has the file's decoder alone.
        small = rules | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        self.decoder = Tokenizer.from_str(json.dumps(small)).decoder

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings of all ids, special tokens too, put together by the file's decoder."""
        names = list(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return " ".join(names) if self.decoder is None else self.decoder.decode(names)


def slices(text: str) -> Iterator[str]:
    """A long text in parts that end before an ASCII blank, so that not all of its words are in memory at once."""
    at = 0
    while len(text) - at > CHARACTERS_AT_ONCE:
        end = BLANK.search(text, at + CHARACTERS_AT_ONCE)
        if not end:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:] if at else text


_loaded: dict[tuple[type, int], object] = {}


def loaded(kind: type, definition: str):
    """A worker's one ``Coder`` or ``Names`` of a definition."""
    key = kind, zlib.crc32(definition.encode())
    if key not in _loaded:
        _loaded[key] = kind(definition)
    return _loaded[key]


def _definition(df: DataFrame, tokenizer: str | None):
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        text = file.read()
    Coder(text)  # what is not known here is refused before any task runs
    return ready(df).sparkContext.broadcast(text)  # a vocabulary, independent of the corpus


def _instead(df: DataFrame, source: str, column: str, kind: pa.DataType, ddl: str, function) -> DataFrame:
    """``df`` with a column made from another one in its stead; small output batches, as ids and texts can be long."""
    position = df.columns.index(source)
    schema = T.StructType([f for f in df.schema.fields if f.name != source]).add(column, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            values, others = batch.column(position), [c for nth, c in enumerate(batch.columns) if nth != position]
            made, first, held = [], 0, 0
            for nth in range(batch.num_rows):
                made.append(apply(values[nth].as_py()))
                held += len(made[-1])
                if held >= OUTPUT_BYTES or nth + 1 == batch.num_rows:
                    part = [c.slice(first, len(made)) for c in others]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(made, kind)], names=schema.names)
                    made, first, held = [], nth + 1, 0

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: its id and ``ids``, little-endian unsigned 32-bit integers, as the tokenizers library gives them without special tokens of its own.

    ``tokenizer`` is the path of a tokenizers file with a plain BPE model. Whole
    texts are encoded, long ones in parts at blanks where the rules allow it.
    Null texts are empty and have no ids; null and repeated document ids have
    their own rows; an empty table gives an empty one. Other columns are left out.
    """
    definition = _definition(docs, tokenizer)
    texts = docs.select(F.col(id_column).alias("_id"), text_bytes(text_column).alias("_text"))
    encoded = _instead(texts, "_text", "ids", pa.binary(), "binary", lambda: loaded(Coder, definition.value).encode_bytes)
    return encoded.select(F.col("_id").alias(id_column), "ids")


def decode(encoded: DataFrame, tokenizer: str | None = None, ids_column: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the vocabulary's strings of the ids, as the tokenizers library's ``decode`` with special tokens kept.

    Null ids decode to the empty text. A column named ``decoded`` is replaced.
    """
    definition = _definition(encoded, tokenizer)
    whole = encoded.drop("decoded").withColumn("_ids", F.coalesce(F.col(ids_column), F.lit(b"")))
    return _instead(whole, "_ids", "decoded", pa.string(), "string", lambda: loaded(Names, definition.value).decode)
