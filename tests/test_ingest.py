import gzip
import hashlib
import random
from pathlib import Path

import pytest
from fleet_tables import synthetic_lines, write_lines
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.sources import export

HEADER = ("Date;Time;CO(GT);PT08.S1(CO);NMHC(GT);C6H6(GT);PT08.S2(NMHC);NOx(GT);PT08.S3(NOx);NO2(GT);"
          "PT08.S4(NO2);PT08.S5(O3);T;RH;AH;;")
ROWS = [
    "01/02/2005;10.00.00;1,5;1100;-200;7,1;900;120;950;100;1500;1000;-1,9;55,0;0,6612;;",
    "01/02/2005;11.00.00;-200;1150;-200;7,4;910;-200;940;-200;1510;1040;-200;53,5;0,6571;;",
    "01/02/2005;09.00.00;2,25;1210;88;9,0;939;131;1140;114;1555;1074;11,9;54,0;0,7502;;",
    ";" * 16,
]


def load(spark, folder, rows, **kw):
    return export.load_export(spark, write_lines(folder, [HEADER, *rows]), **kw)


def test_three_rows(spark, tmp_path):
    rows = load(spark, tmp_path, ROWS)
    assert rows.columns[:2] == ["device_id", "ts"] and len(rows.columns) == 15
    got = [tuple(r) for r in rows.orderBy("ts").collect()]
    assert [str(r[1]) for r in got] == [f"2005-02-01 {h}:00:00" for h in ("09", "10", "11")]
    assert got[0][2:] == (2.25, 1210, 88, 9.0, 939, 131, 1140, 114, 1555, 1074, 11.9, 54.0, 0.7502)
    assert got[1][2:] == (1.5, 1100, None, 7.1, 900, 120, 950, 100, 1500, 1000, -1.9, 55.0, 0.6612)
    assert got[2][2:] == (None, 1150, None, 7.4, 910, None, 940, None, 1510, 1040, None, 53.5, 0.6571)
    assert {r[0] for r in got} == {"station"}
    assert dict(rows.dtypes)["ts"] == "timestamp_ntz"


def test_time_zone_has_no_influence(spark, tmp_path):
    rows = [ROWS[0].replace("01/02/2005;10.00.00", "27/03/2005;02.30.00")]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")  # this hour does not exist there
    try:
        got = load(spark, tmp_path, rows).select(F.col("ts").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2005-03-27 02:30:00"


@pytest.mark.parametrize("rows, message", [
    ([*ROWS, ROWS[0]], "1 duplicated"),
    ([ROWS[0].replace("1100", "abc"), ROWS[1]], "non-numeric"),
    ([ROWS[0].replace("1100", "1f"), ROWS[1]], "non-numeric"),
    ([ROWS[0].replace("1100", "inf"), ROWS[1]], "non-numeric"),
    ([ROWS[0].replace("10.00.00", ""), ROWS[1]], "date without time"),
    ([ROWS[0].replace("01/02/2005", " "), ROWS[1]], "date without time"),
    ([ROWS[0].replace("01/02/2005", "31/02/2005"), ROWS[1]], "timestamp"),
    ([ROWS[0].replace("01/02/2005", "2005-02-01"), ROWS[1]], "timestamp"),
    ([ROWS[0].replace("10.00.00", "10.00.60"), ROWS[1]], "timestamp"),
])
def test_strict_input(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        load(spark, tmp_path, rows)


def test_lenient_input_keeps_the_good_rows(spark, tmp_path):
    bad = [ROWS[0].replace("1100", "abc"), ROWS[1], ROWS[2].replace("09.00.00", "")]
    raw = export.read_text(spark, write_lines(tmp_path, [HEADER, *bad]))
    found = export.ingest(raw, strict=False)
    assert found.rows.count() == 1
    assert {r["problem"] for r in found.rejects.collect()} == {export.BAD_NUMBER, export.INCOMPLETE}


@pytest.mark.parametrize("text", ["NA", "N/A", "null", "None", "nan", "", "  ", "-200", "-200,0", "-2e2"])
def test_missing_values(spark, tmp_path, text):
    rows = load(spark, tmp_path, [ROWS[0].replace("1100", text)])
    assert rows.first()["PT08.S1(CO)"] is None


def test_unpadded_and_blank_surrounded_fields(spark, tmp_path):
    rows = load(spark, tmp_path, [ROWS[0].replace("01/02/2005;10.00.00;1,5", " 1/2/2005 ; 9.0.0; 1.5 ")])
    found = rows.first()
    assert str(found["ts"]) == "2005-02-01 09:00:00" and found["CO(GT)"] == 1.5


def test_unnamed_column_with_content_stays(spark, tmp_path):
    rows = load(spark, tmp_path, [ROWS[0][:-1] + "7;", ROWS[1]])
    assert len(rows.columns) == 16 and rows.select(F.max(q(rows.columns[-1]))).first()[0] == 7.0


def test_missing_key_column_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError, match="Time"):
        export.load_export(spark, write_lines(tmp_path, ["Date;CO(GT)", "01/02/2005;1,5"]))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        export.load_export(spark, str(tmp_path / "absent.csv"))


def test_many_files_are_many_devices(spark, tmp_path):
    lines = synthetic_lines(30)
    write_lines(tmp_path, lines, "north.csv"), write_lines(tmp_path, lines, "south.csv")
    rows = export.load_export(spark, str(tmp_path / "*.csv"))
    assert {(r["device_id"], r["count"]) for r in rows.groupBy("device_id").count().collect()} == {
        ("north", 30), ("south", 30)}


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("other", [HEADER.replace("T;RH", "RH;T"), HEADER + ";x", None])
def test_files_with_different_headers_are_refused(spark, tmp_path, strict, other):
    write_lines(tmp_path, [HEADER, ROWS[0]], "a.csv")
    write_lines(tmp_path, [line for line in (other, ROWS[1]) if line], "b.csv")
    with pytest.raises(ValueError, match=r"not the header that.*[ab]\.csv"):
        export.load_export(spark, str(tmp_path / "*.csv"), strict=strict)


def test_surplus_fields_are_a_problem(spark, tmp_path):
    path = write_lines(tmp_path, [HEADER, ROWS[0], ROWS[1] + ";8;7", ";" * 40])
    with pytest.raises(ValueError, match="2 row.*more fields"):
        export.load_export(spark, path)
    found = export.ingest(export.read_text(spark, path), strict=False)
    assert found.rows.count() == 1
    assert [r["problem"] for r in found.rejects.collect()] == [export.SURPLUS] * 2


def test_lines_in_a_table_parse_like_a_file(spark, tmp_path):
    lines = spark.createDataFrame([("station", r) for r in ROWS], "device_id string, line string")
    header = HEADER.split(";")
    parsed = export.drop_empty_unnamed(export.parse_rows(export.split_lines(lines, header))).drop("problem")
    from_file = load(spark, tmp_path, ROWS)
    assert sorted(map(tuple, parsed.collect()), key=str) == sorted(map(tuple, from_file.collect()), key=str)


def test_fingerprint(spark, tmp_path):
    path = write_lines(tmp_path, [HEADER, *ROWS])
    found = export.fingerprint(spark, path)
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert found.first()["digest"] == digest
    good = found.select("file", "digest")
    export.check_fingerprint(found, good)
    with pytest.raises(ValueError, match="differs"):
        export.check_fingerprint(found, good.withColumn("digest", F.lit("0")))


def test_absent_and_unexpected_files_are_noticed(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        write_lines(tmp_path, [HEADER, *ROWS], name)
    both = export.fingerprint(spark, str(tmp_path / "*.csv")).select("file", "digest")
    one = export.fingerprint(spark, str(tmp_path / "a.csv")).select("file", "digest")
    for found, expected in ((both, one), (one, both)):
        with pytest.raises(ValueError, match="b.csv"):
            export.check_fingerprint(found, expected)


def test_line_sums_and_the_limit_of_whole_files(spark, tmp_path):
    path = write_lines(tmp_path, [HEADER, *ROWS])
    turned = write_lines(tmp_path, [ROWS[2], HEADER, ROWS[0], ROWS[1], ROWS[3]], "turned.csv")
    changed = write_lines(tmp_path, [HEADER, *ROWS[1:], ROWS[1]], "changed.csv")
    first, second, third = [export.fingerprint(spark, p, export.LINE_SUM).first() for p in (path, turned, changed)]
    assert first["kind"] == "line_sum" and first["digest"] == second["digest"] != third["digest"]
    with pytest.raises(ValueError, match="too large"):
        export.fingerprint(spark, path, whole_file_bytes=10)
    with pytest.raises(ValueError, match="unknown method"):
        export.fingerprint(spark, path, "md5")


@pytest.mark.parametrize("split_bytes", ["1000", "134217728"])
def test_large_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch, split_bytes):
    """Any bytes, with and without a last line feed or a byte order mark, in one split and in many, beside small files."""
    rng, mark = random.Random(5), b"\xef\xbb\xbf"
    noise = rng.randbytes(40_000)
    cases = {
        "noise": noise, "ended": noise + b"\n", "fed": b"\n\n" + noise + b"\n\n\n", "text": b"a;b\r\n" * 9_000 + b"c", "feeds": b"\n" * 20_000,
        "long": b"\x00" * 30_000, "marked": mark + noise, "marked_ended": mark + noise + b"\n", "twice": mark + mark + noise[:20_000],
        "marks": mark * 9_000, "name with space": noise[:19_000], "small": b"x\n", "just": noise[:10_000], "more": noise[:10_001],
        "packed.gz": gzip.compress(noise),
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(export, "IN_TURN_BYTES", 10_000)
    monkeypatch.setattr(export, "CHUNK_BYTES", 1_500)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        plain = export.fingerprint(spark, str(tmp_path / "*"), whole_file_bytes=1 << 20)
        found = {Path(r["file"]).name: (r["kind"], r["digest"]) for r in plain.collect()}
        again = {Path(r["file"]).name: (r["kind"], r["digest"]) for r in export.fingerprint(spark, str(tmp_path / "*")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == again == {name: ("sha256", hashlib.sha256(content).hexdigest()) for name, content in cases.items()}
    with pytest.raises(ValueError, match="too large"):
        export.fingerprint(spark, str(tmp_path / "noise"), whole_file_bytes=39_999)


def test_files_above_a_gibibyte_are_not_refused_by_their_size(spark, tmp_path):
    """One sparse file of holes and lines: above what one value may hold by default, but not too large to be hashed."""
    path, digest = tmp_path / "big", hashlib.sha256()
    with open(path, "wb") as f:
        for _ in range(1100):
            part = (b"\x00" * 65_535 + b"\n") * 16
            f.write(part)
            digest.update(part)
    assert path.stat().st_size > 1 << 30
    assert export.fingerprint(spark, str(path)).first()["digest"] == digest.hexdigest()
