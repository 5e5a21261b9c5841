"""Personal data by bootstrapped contextual extraction.

Four base patterns give sure entities, the seeds. Every seed, and every other
run of tokens that looks like an identifier, is an instance that stands in lexical
patterns: the word before it, the two words before it, the words on both sides.
A run is as long as it can be: groups of digits one after the other, an address
spelt with "at" and "dot", or else one token.
Patterns and instances form a graph that Spark scores in rounds. For each kind
a pattern has instances that speak for it (seeds of the kind, and to the degree
that they are believed in, others that can be of it by their form) and against it
(seeds of other kinds, and what cannot be of the kind); its score is the share of
the former. An instance's belief is one less the doubt that all its trusted patterns
leave. Instances in trusted patterns whose form allows the kind are reported under
it, next to the base ones.

Only distinct (pattern, instance) pairs are scored, so copied documents add no
evidence, and a pattern is an aggregate, never a collected group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ready, stored, text_bytes

KINDS = ("email", "ip", "card", "phone")
NOT_ADDRESS = re.compile(r"[^A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")  # one with a digit or @
GROUP = re.compile(r"[(+]*+[0-9][0-9()./-]*+")  # of digits; several of them, one blank apart, are one identifier
SPELT = re.compile(
    r"(?<![^\x20\x09-\x0D])[A-Za-z0-9._%+-]++\x20(?:at|[(\[]at[)\]])\x20"
    r"[A-Za-z0-9-]++(?:\x20(?:dot|[(\[]dot[)\]])\x20[A-Za-z0-9-]++)++", re.IGNORECASE,
)
AT = re.compile(r"[(\[]at[)\]]|\x20at\x20", re.IGNORECASE)
HEX_PARTS = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
DIGITS = re.compile(r"[0-9]+")
EDGES = ".,;:!?\"'()[]{}<>#*$%&|"
_NOT_CLUE = bytes(c for c in range(256) if c not in b"0123456789@")
NEAR = 200  # characters on each side that are looked at first; more until the context words are whole


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    trusted: float = 0.8  # score from which a pattern is trusted
    support: int = 5  # different seeds of the kind that a pattern needs
    least_length: int = 6  # characters of an instance that is no seed
    least_digits: int = 3  # digits of one without an @ or a spelt "at"


def luhn(digits: str) -> bool:
    total = 0
    for nth, digit in enumerate(reversed(digits)):
        value = int(digit)
        total += value if nth % 2 == 0 else (2 * value - 9 if value > 4 else 2 * value)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, from the @ outwards, in linear time on any text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        begin, step = at, 64
        while begin > last:  # back over the local part, in growing strides
            low = max(last, begin - step)
            breaks = [m.end() for m in NOT_ADDRESS.finditer(text, low, begin)]
            if breaks:
                begin = breaks[-1]
                break
            begin, step = low, step * 2
        host = HOST.match(text, at + 1) if begin < at else None
        if host:
            found.append((begin, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    clues = text.encode("utf-8", "replace").translate(None, _NOT_CLUE)
    if not clues:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if b"@" in clues else []
    if len(clues) > clues.count(b"@"):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def possible_kinds(token: str) -> int:
    """Bit per kind that an instance which is no seed can be of by its form."""
    digits = "".join(c for c in token if c in "0123456789")
    numeric = not token.strip("0123456789()./+- ")
    return (
        ("@" in token or bool(AT.search(token))) << 0 | bool(HEX_PARTS.fullmatch(token)) << 1
        | (12 <= len(digits) <= 19 and luhn(digits) and numeric) << 2 | (7 <= len(digits) <= 15 and numeric) << 3
    )


def words_before(text: str, start: int, count: int) -> list[str]:
    """The last whole words in front of a place, at most ``count``."""
    size = NEAR
    while True:
        low = max(0, start - size)
        words = text[low:start].split()
        if low == 0 or len(words) > count:  # the first one may be cut
            return words[-count:]
        size *= 2


def word_after(text: str, end: int) -> str:
    size = NEAR
    while True:
        words = text[end:end + size].split(maxsplit=1)
        if len(words) > 1 or end + size >= len(text):
            return words[0] if words else ""
        size *= 2


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span."""
    before = [DIGITS.sub("0", w.lower()) for w in words_before(text, start, 2)]
    after = DIGITS.sub("0", word_after(text, end).lower())
    before = [""] * (2 - len(before)) + before
    found = [f"1 {before[1]}", f"2 {before[0]} {before[1]}", f"3 {before[1]} {after.strip(EDGES)}"]
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in found if p[2:].strip()]


def candidates(text: str, settings: Settings) -> Iterator[tuple[int, int]]:
    """Runs of tokens that look like one identifier, by their start, none inside another."""
    spelt = [m.span() for m in SPELT.finditer(text)] if "dot" in text.lower() else []
    run: tuple[int, int] | None = None  # groups of digits so far

    def whole(start: int, end: int) -> bool:
        token = text[start:end]
        return len(token) >= settings.least_length and (
            "@" in token or sum(c in "0123456789" for c in token) >= settings.least_digits
        )

    at = 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(spelt) and spelt[at][0] <= start:
            if run and whole(*run):
                yield run
            run = None
            yield spelt[at]
            at += 1
        if at and start < spelt[at - 1][1]:
            continue
        while start < end and text[start] in EDGES and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in EDGES and text[end - 1] != ")":
            end -= 1
        if not GROUP.fullmatch(text, start, end):
            while start < end and text[start] in EDGES:
                start += 1
            while end > start and text[end - 1] in EDGES:
                end -= 1
            if run and whole(*run):
                yield run
            run = None
            if whole(start, end):
                yield start, end
            continue
        closed = end < m.end()  # a mark after the group ends the run
        if run and text[run[1]:start] == " ":
            run = run[0], end
        else:
            if run and whole(*run):
                yield run
            run = start, end
        if closed:
            if whole(*run):
                yield run
            run = None
    if run and whole(*run):
        yield run
    yield from spelt[at:]


def instances(text: str, base: list[tuple[int, int, int]], settings: Settings) -> list[dict]:
    """All seeds, and identifier-like runs that touch no seed, with their patterns."""
    def instance(start: int, end: int, kind: int | None) -> dict:
        name = xxhash.xxh64_intdigest(text[start:end].lower()) - (1 << 63)
        like = possible_kinds(text[start:end]) if kind is None else 0
        return {"start": start, "end": end, "kind": kind, "like": like, "name": name, "patterns": patterns(text, start, end)}

    found = [instance(a, b, kind) for a, kind, b in base]
    seeds, at, reach = sorted((a, b) for a, _, b in base), 0, 0
    if not text.encode("utf-8", "replace").translate(None, _NOT_CLUE) and "dot" not in text.lower():
        return found
    for start, end in candidates(text, settings):
        while at < len(seeds) and seeds[at][0] < end:
            reach, at = max(reach, seeds[at][1]), at + 1
        if start >= reach:
            found.append(instance(start, end, None))
    return found


def extracted(docs: DataFrame, settings: Settings) -> DataFrame:
    """_row, doc_id and the instances of every row."""
    ready(docs)
    kind = pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("like", pa.int32()), ("name", pa.int64()), ("patterns", pa.list_(pa.int64()))
    ])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column("text"):
                text = value.as_py().decode("utf-8", "replace")
                found.append(instances(text, base_spans(text), settings))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(found, pa.list_(kind))], ["_row", "doc_id", "instances"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(
        of_batches, "_row long, doc_id long, instances array<struct<start:long,end:long,kind:int,like:int,name:long,patterns:array<long>>>"
    )


def trusted_patterns(edges: DataFrame, settings: Settings) -> DataFrame:
    """(pattern, kind, score) after the rounds; ``edges`` has distinct pattern, name, the seed kind or null, and like."""
    kinds = range(len(KINDS))
    seed, unknown_ = F.col("kind").isNotNull(), F.col("kind").isNull()
    facts = [
        F.struct(
            F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("seeds"),
            F.count_if((seed & (F.col("kind") != k)) | (unknown_ & (F.expr(f"shiftright(like, {k}) % 2") == 0))).alias("against"),
        ) for k in kinds
    ]
    # Only unknown instances of supported patterns take part in the rounds; seeds keep their belief of one.
    supported = stored(edges.groupBy("pattern").agg(F.array(*facts).alias("facts")).select("pattern", F.explode("facts").alias("f")).select(
        "pattern", "f.*"
    ).filter(F.col("seeds") >= settings.support))
    unknown = stored(edges.filter(unknown_).join(supported.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "name", "like"))

    def scored(gained: Column) -> Column:
        return (F.col("seeds") + gained) / (F.col("seeds") + gained + F.col("against"))

    trusted = supported.withColumn("score", scored(F.lit(0.0))).filter(F.col("score") >= settings.trusted)
    for _ in range(settings.rounds):
        belief = believed(unknown, trusted)
        gained = unknown.join(belief, "name").groupBy("pattern", "kind").agg(F.sum("belief").alias("gained"))
        anew = supported.join(gained, ["pattern", "kind"], "left").withColumn("score", scored(F.coalesce("gained", F.lit(0.0))))
        trusted = stored(anew.filter(F.col("score") >= settings.trusted))
    return trusted.select("pattern", "kind", "score")


def allowed(joined: DataFrame) -> DataFrame:
    """Only rows whose instance can be of the pattern's kind."""
    return joined.filter(F.expr("shiftright(like, kind) % 2 = 1"))


def believed(unknown: DataFrame, trusted: DataFrame) -> DataFrame:
    """(name, kind, belief): one less the product of the doubts that the trusted patterns of an instance leave."""
    doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999)))))
    met = allowed(unknown.join(trusted.select("pattern", "kind", "score"), "pattern"))
    return met.groupBy("name", "kind").agg((1 - doubt).alias("belief"))


def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, base and found of every row: arrays of (start, kind, end), kind as its place in KINDS.

    ``found`` are the spans that patterns add; where several kinds trust an
    instance, the most believed one names it. Null and empty texts have no
    spans; repeated rows get a row each; an empty table gives none.
    """
    rows = stored(extracted(docs, settings))
    each = rows.select("_row", F.explode("instances").alias("i")).select("_row", "i.*")
    edges = stored(each.select(F.explode("patterns").alias("pattern"), "name", "kind", "like").distinct())
    trusted = trusted_patterns(edges, settings)
    open_ = each.filter("kind IS NULL").select("_row", "start", "end", "like", F.explode("patterns").alias("pattern"))
    best = allowed(open_.join(trusted, "pattern")).groupBy("_row", "start", "end").agg(
        F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")
    )
    found = best.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base = F.transform(
        F.filter("instances", lambda i: i["kind"].isNotNull()), lambda i: F.struct(i["start"], i["kind"], i["end"])
    )
    return rows.join(found, "_row", "left").select(
        "doc_id", F.array_sort(base).alias("base"), F.array_sort(F.coalesce("found", nothing)).alias("found")
    )


def joined_spans(spans: Column | str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
