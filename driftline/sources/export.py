"""Reading ``;``-separated measurement exports with decimal commas.

Text is read once: rows are typed, every rule violation is noted in a
``problem`` column, and the checks then run on a columnar copy.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import day_first_timestamp, measurement, q, text_or_null, valid_field
from driftline.session import keep_columnar

DATE, TIME = "Date", "Time"
DIALECT = {"sep": ";", "ignoreLeadingWhiteSpace": "true"}
UNNAMED = re.compile(r"_c\d+")

FILE, SURPLUS_FIELDS = "_file", "_surplus_fields"

SURPLUS = "more fields than the header"
INCOMPLETE = "date without time or time without date"
BAD_TIME = "invalid timestamp"
BAD_NUMBER = "non-numeric measurement"
PROBLEMS = (SURPLUS, INCOMPLETE, BAD_TIME, BAD_NUMBER)


def read_text(spark: SparkSession, paths: str | Sequence[str], device: str | None = None) -> DataFrame:
    """All fields as text, plus the device: a given name, else the file's own name.

    Every file must begin with the same header; a file with another one, or
    with none, is refused, as its fields would get wrong names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.options(header="true", **DIALECT).csv(paths).columns
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    lines = spark.read.text(paths).select(
        (F.lit(device) if device else stem).alias("device_id"), F.col("_metadata.file_path").alias(FILE),
        F.col("value").alias("line"),
    ).filter(F.trim("line") != "")
    rows = split_lines(lines, header)
    is_header = F.lit(True)
    for c in header:
        is_header = is_header & (q(c).isNull() if UNNAMED.fullmatch(c) else q(c).eqNullSafe(F.lit(c)))
    is_header = is_header & ~q(SURPLUS_FIELDS)
    # A line that names both key columns is a header, of this order or another.
    fields = F.split(F.col("line"), DIALECT["sep"])
    named = F.exists(fields, lambda f: F.trim(f) == DATE) & F.exists(fields, lambda f: F.trim(f) == TIME)
    own = rows.groupBy(FILE).agg(F.count_if(is_header).alias("same"))
    any_ = lines.groupBy(FILE).agg(F.count_if(named).alias("headers"))
    bad = own.join(any_, FILE).filter((F.col("same") < 1) | (F.col("headers") > F.col("same"))).select(FILE)
    foreign = [r[0] for r in bad.orderBy(FILE).limit(5).collect()]
    if foreign:
        raise ValueError(f"not the header that was read first, {header}: {foreign}")
    return rows.filter(~is_header).drop(FILE)


def split_lines(lines: DataFrame, header: Sequence[str], line: str = "line") -> DataFrame:
    """The fields of lines in a table, and whether a line has more of them than the header; other columns are kept."""
    names = [name or f"_c{i}" for i, name in enumerate(header)]
    schema = ", ".join(f"`{name}` STRING" for name in names)
    others = [q(c) for c in lines.columns if c != line]
    unquoted = F.regexp_replace(q(line), '"[^"]*"', "")
    surplus = (F.size(F.split(unquoted, DIALECT["sep"], -1)) > len(names)).alias(SURPLUS_FIELDS)
    fields = F.from_csv(q(line), schema, DIALECT)
    return lines.select(*others, surplus, fields.alias("_fields")).select(*others, SURPLUS_FIELDS, "_fields.*")


def parse_rows(raw: DataFrame, device: str = "device_id", time: str = "ts") -> DataFrame:
    """Typed rows ``(device, ts, measurements..., problem)``; separator-only lines are left out.

    Lines with more fields than the header are a problem if ``split_lines`` has marked them.
    """
    for key in (DATE, TIME):
        if key not in raw.columns:
            raise ValueError(f"no {key!r} column among {raw.columns}")
    names = [c for c in raw.columns if c not in (device, DATE, TIME, SURPLUS_FIELDS)]
    surplus = q(SURPLUS_FIELDS) if SURPLUS_FIELDS in raw.columns else F.lit(False)
    # Each step uses the one before more than once, so the optimizer keeps them apart.
    keyed = raw.select(
        q(device), surplus.alias("_surplus"), text_or_null(q(DATE)).alias("_date"), text_or_null(q(TIME)).alias("_time"),
        *[q(c) for c in names],
    ).filter("_surplus OR coalesce(_date, _time) IS NOT NULL")
    typed = keyed.select(
        q(device), "_surplus", (F.col("_date").isNull() | F.col("_time").isNull()).alias("_incomplete"),
        day_first_timestamp(F.col("_date"), F.col("_time")).alias(time),
        *[measurement(q(c)).alias(c) for c in names], reduce(and_, [valid_field(q(c)) for c in names]).alias("_valid"),
    )
    problem = F.when(F.col("_surplus"), SURPLUS).when(F.col("_incomplete"), INCOMPLETE).when(q(time).isNull(), BAD_TIME).when(~F.col("_valid"), BAD_NUMBER)
    return typed.select(q(device), q(time), *[q(c) for c in names], problem.alias("problem"))


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Rows per broken rule."""
    return parsed.filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n_rows"))


def drop_empty_unnamed(parsed: DataFrame, filled: dict[str, int] | None = None) -> DataFrame:
    """Drop the columns that have neither a name nor any value."""
    unnamed = [c for c in parsed.columns if UNNAMED.fullmatch(c)]
    if not unnamed:
        return parsed
    if filled is None:
        filled = parsed.agg(*[F.count(q(c)).alias(c) for c in unnamed]).first().asDict()
    return parsed.drop(*[c for c in unnamed if filled[c] == 0])


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ("device_id", "ts")) -> DataFrame:
    """Keys that occur more than once, with the number of repeats beyond the first row."""
    counted = rows.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("n"))
    return counted.filter("n > 1").select(*[q(k) for k in keys], (F.col("n") - 1).alias("repeats"))


def check_unique(rows: DataFrame, keys: Sequence[str] = ("device_id", "ts")) -> None:
    repeats = duplicate_keys(rows, keys).agg(F.sum("repeats").alias("n")).first()["n"]
    if repeats:
        raise ValueError(f"{repeats} duplicated timestamp(s)")


@dataclass(frozen=True)
class Ingested:
    """Accepted rows and what was refused."""

    rows: DataFrame
    rejects: DataFrame


def ingest(raw: DataFrame, strict: bool = True, device: str = "device_id", time: str = "ts") -> Ingested:
    """Parse, check and return the rows.

    ``strict`` refuses the whole input when any row breaks a rule; otherwise
    such rows go to ``rejects``. Repeated keys are refused in both modes.
    """
    parsed = keep_columnar(parse_rows(raw, device, time))
    unnamed = [c for c in parsed.columns if UNNAMED.fullmatch(c)]
    facts = parsed.agg(
        *[F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS],
        *[F.count(q(c)).alias(c) for c in unnamed],
    ).first().asDict()
    if strict:
        for problem in PROBLEMS:
            if facts[problem]:
                raise ValueError(f"{facts[problem]} row(s): {problem}")
    parsed = drop_empty_unnamed(parsed, facts)
    rows = parsed.filter("problem IS NULL").drop("problem")
    check_unique(rows, (device, time))
    return Ingested(rows, parsed.filter("problem IS NOT NULL"))


def load_export(
    spark: SparkSession, paths: str | Sequence[str], device: str | None = None, strict: bool = True
) -> DataFrame:
    """Read, check and type one or many exports."""
    return ingest(read_text(spark, paths, device), strict).rows


SHA256, LINE_SUM = "sha256", "line_sum"


IN_TURN_BYTES = 64 << 20  # a file above that is hashed in chunks
CHUNK_BYTES = 1 << 14
WHOLE_FILE_BYTES = 1 << 30  # of files that the text source would unpack
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def fingerprint(
    spark: SparkSession, paths: str | Sequence[str], method: str = SHA256, whole_file_bytes: int | None = None
) -> DataFrame:
    """``(file, kind, digest)`` of every input file, by one method for all.

    ``sha256`` reads a large file in splits by many tasks; one task then hashes
    its chunks in turn, as every step needs the one before. Files above
    ``whole_file_bytes``, if given, and packed ones above ``WHOLE_FILE_BYTES``
    are refused. ``line_sum`` is for text: the sum of the lines' 64-bit hashes
    and their count, which any number of tasks can add up; it does not see the
    order of lines.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if method == LINE_SUM:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
        sums = lines.groupBy("file").agg(*line_digest(F.col("value")))
        return sums.select("file", F.lit(method).alias("kind"), F.concat_ws(":", "line_hash_sum", "lines").alias("digest"))
    if method != SHA256:
        raise ValueError(f"unknown method {method!r}")
    files = spark.read.format("binaryFile").load(paths)
    packed = F.lower("_metadata.file_path").rlike(PACKED)
    most = F.when(packed, WHOLE_FILE_BYTES).otherwise(sys.maxsize) if whole_file_bytes is None else F.lit(whole_file_bytes)
    refused = [r["path"] for r in files.filter(F.col("length") > most).select("path").limit(5).collect()]
    if refused:
        raise ValueError(f"too large for {SHA256} in one task, use {LINE_SUM!r}: {refused}")
    # Content is not read of files that go by one of these conditions alone.
    small, in_turn = files.filter(F.col("length") <= IN_TURN_BYTES), files.filter(F.col("length") > IN_TURN_BYTES)
    whole = small.unionByName(in_turn.filter(packed)).select("path", F.sha2("content", 256).alias("digest"))
    large = in_turn.filter(~packed).select("path", F.col("_metadata.file_path").alias("at"), "length")
    count = large.count()
    found = whole.unionByName(_hashed_in_turn(spark, paths, large, count)) if count else whole
    return found.select(F.col("path").alias("file"), F.lit(method).alias("kind"), "digest")


def _hashed_in_turn(spark: SparkSession, paths: list[str], large: DataFrame, count: int) -> DataFrame:
    """``(path, digest)`` of ``count`` large files of any content, in bounded memory as long as the bytes between two line feeds are.

    The text source cuts any bytes at line feeds and leaves these out, and a byte
    order mark at the front; the file's length tells whether it had a last line feed and a mark.
    """
    lines = spark.read.text(paths, lineSep="\n").filter(
        (F.col("_metadata.file_size") > IN_TURN_BYTES) & ~F.lower("_metadata.file_path").rlike(PACKED)
    ).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a split, each with a line feed, in chunks."""
        split, nth, rest = None, 0, b""

        def chunks(data: bytes) -> pa.RecordBatch:
            parts = [data[a:a + CHUNK_BYTES] for a in range(0, len(data), CHUNK_BYTES)]
            return pa.RecordBatch.from_arrays([
                pa.repeat(split[0], len(parts)), pa.repeat(pa.scalar(split[1], pa.int64()), len(parts)),
                pa.array(range(nth, nth + len(parts)), pa.int64()), pa.array(parts, pa.binary()),
            ], ["at", "start", "nth", "bytes"])

        for batch in batches:
            owner, start = batch.column("at").dictionary_encode(), batch.column("start").to_numpy()
            named = owner.indices.to_numpy()
            cuts = np.flatnonzero((start[1:] != start[:-1]) | (named[1:] != named[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                mine = owner.dictionary[int(named[a])].as_py(), int(start[a])
                if mine != split:
                    if rest:
                        yield chunks(rest)
                    split, nth, rest = mine, 0, b""
                rest += b"\n".join([*batch.column("line").slice(a, b - a).to_pylist(), b""])
                full = len(rest) // CHUNK_BYTES * CHUNK_BYTES
                if full:
                    yield chunks(rest[:full])
                    nth, rest = nth + full // CHUNK_BYTES, rest[full:]
        if rest:
            yield chunks(rest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each file from its length, which comes first, and its chunks; the last byte waits until the file has ended."""
        path, length, seen, last, states = None, 0, 0, b"", {}

        def digest() -> pa.RecordBatch:
            for mark, state in states.items():
                if seen == length - len(mark):
                    state.update(last)
                if length - len(mark) <= seen <= length - len(mark) + 1:
                    return pa.RecordBatch.from_pydict({"path": [path], "digest": [state.hexdigest()]})
            raise ValueError(f"{path}: {length} bytes, {seen} of its lines")

        for batch in batches:
            for own, size, part in zip(*(batch.column(c) for c in ("path", "length", "bytes"))):
                if part.is_valid:
                    data = part.as_py()
                    for state in states.values():
                        state.update(last)
                        state.update(memoryview(data)[:-1])
                    last, seen = data[-1:], seen + len(data)
                    continue
                if path is not None:
                    yield digest()
                path, length, seen, last = own.as_py(), size.as_py(), 0, b""
                states = {mark: hashlib.sha256(mark) for mark in (b"", BYTE_ORDER_MARK)}
        if path is not None:
            yield digest()

    first = large.select("path", "at", "length", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("nth"))
    parts = first.unionByName(lines.mapInArrow(pack, "at string, start long, nth long, bytes binary"), allowMissingColumns=True)
    ordered = parts.repartition(count, "at").sortWithinPartitions("at", "start", "nth")
    return ordered.select("path", "length", "bytes").mapInArrow(hashed, "path string, digest string")


def line_digest(line: Column) -> list[Column]:
    """Order-free digest of lines: sum of hashes and count."""
    return [
        F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("line_hash_sum"),
        F.count("*").alias("lines"),
    ]


def changed_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(file, digest, expected)`` where the two differ; a file that only one side has differs too."""
    known = expected.select("file", F.col("digest").alias("expected"))
    return found.select("file", "digest").join(known, "file", "full").filter(~F.col("digest").eqNullSafe(F.col("expected")))


def check_fingerprint(found: DataFrame, expected: DataFrame) -> None:
    bad = changed_files(found, expected).select("file").orderBy("file").limit(5).collect()
    if bad:
        raise ValueError(f"input differs from the expected digest: {[r['file'] for r in bad]}")
