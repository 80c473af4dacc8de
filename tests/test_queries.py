"""Each registered query of the library against its SQL in DuckDB, and operators that have no query of their own."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from mediaframe import queries
from mediaframe.functions import bytesx as bx
from mediaframe.functions import scalars as sc
from mediaframe.operators import admission, compare, naming, report, selection, tables, verify
from mediaframe.plans import codecs, planner, policy

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names))) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toArrow()
    if name not in queries.SQL:
        assert got.num_rows > 0
        return
    found = duck.sql(queries.SQL[name]).arrow()
    want = found.read_all() if hasattr(found, "read_all") else found
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 40
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


def test_bytes(spark):
    df = spark.createDataFrame([(bytes.fromhex("0000000d80ff"), 1), (b"", 2), (None, 3), (b"\xff" * 8, 4)], "b binary, k int")
    got = df.select(bx.be(F.col("b"), 0, 4), bx.le(F.col("b"), 4, 2), bx.u8(F.col("b"), 9), bx.be(F.col("b"), 0, 8), bx.is_padding(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(13, 65408, None, None, False), (None, None, None, None, True), (None, None, None, None, None), (4294967295, 65535, None, None, True)]
    assert spark.range(1).select(bx.put_le(F.lit(258), 4)).first()[0] == b"\x02\x01\0\0"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(sc.snake_case(F.lit("removeViewBox"))) == "remove_view_box" and value(sc.bytes_text(F.lit(1234567))) == "1.2 MB"
    assert value(sc.base64_lenient(F.lit("aGk =\n!"))) == b"hi" and value(sc.base64_lenient(F.lit("a"))) == b""
    assert tuple(value(sc.reduced(F.lit(72), F.lit(12)))) == (6, 1) and value(sc.natural_key(F.lit("a2"))) < value(sc.natural_key(F.lit("A10")))
    assert value(sc.inflate(sc.deflate(F.encode(F.lit("x" * 99), "UTF-8")))) == b"x" * 99
    assert value(sc.png_bits(F.lit(6), F.lit(16))) == 64 and value(sc.png_bits(F.lit(3), F.lit(16))) is None
    assert value(sc.png_inflated_size(F.lit(1), F.lit(1), F.lit(8), F.lit(True))) == 2 and value(sc.nfc(F.lit("é"))) == "é"
    assert value(sc.ids_to_preserve(F.array(F.lit("path1"), F.lit("logo")))) == ["logo"] and value(sc.ids_to_preserve(F.array(F.lit("logo")))) is None
    assert tuple(value(sc.oriented(F.lit(0), F.lit(1), F.lit(4), F.lit(3), F.lit(6)))) == (1, 0)
    assert value(sc.kraft_complete(F.array(*map(F.lit, [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])))) and not value(sc.kraft_complete(F.array(*map(F.lit, [3, *[0] * 15]))))


def test_names(spark):
    df = spark.createDataFrame([(1, "a.png"), (2, "A.PNG"), (3, "a 2.png"), (4, "a.png"), (5, "b"), (6, "b")], "k int, t string")
    got = {r.k: r.c for r in naming.claim(df, "t", "k", "c").collect()}
    assert got[1] == "a.png" and got[3] == "a 2.png" and got[5] == "b" and got[6] == "b 2" and len({v.lower() for v in got.values()}) == 6
    own = spark.createDataFrame([("/x/a (original).png",), ("/x/a-small.png",), ("/out/b.png",), ("/x/c.png",)], "p string")
    assert [r[0] for r in own.select(naming.is_own_output(F.col("p"), folder="/out")).collect()] == [True, True, True, False]


def test_names_in_long_chains(spark):
    chain = [f"a {n}.jpg" for n in range(2, 61)]
    targets = ["a.jpg", "A.jpg", *chain, "a.JPG", "a 63.jpg", "a.jpg", "a 064.jpg", "d.x/b", "d.x/b", "d.x/b 2", "a 2.jpg", "c.", "c.", "ΑΣ.jpg", "ασ.jpg", "ας.jpg", "ας.jpg"]
    df = spark.createDataFrame(list(enumerate(targets)), "k int, t string")
    got = {r.k: r.c for r in naming.claim(df.repartition(3), "t", "k", "c").collect()}
    # one row after the other: the first keeps its name, others take the next number that is free
    own, first, want = {t.lower() for t in targets}, set(), {}
    for k, t in enumerate(targets):
        stem, dot, ext = t.rpartition(".") if "." in t.rpartition("/")[2] else (t, "", "")
        name, n = t, 1
        while name.lower() in first or n > 1 and name.lower() in own:
            n += 1
            name = f"{stem} {n}{dot}{ext}"
        first.add(name.lower())
        want[k] = name
    assert len(first) == len(targets) and len({v.lower() for v in got.values()}) == len(targets)
    assert got[1] == "A 61.jpg" and got[61] == "a 62.JPG" and got[63] == "a 64.jpg"
    assert {k: got[k] for k in range(70)} == {k: want[k] for k in range(70)}


def test_fold_rolls_back_and_aborts(spark):
    schema = "file_id long, stage int, cand int, name string, size long, verified boolean, lossy boolean, minimum_gain double, required boolean, judged_finished boolean, promised boolean, has_private boolean"
    c = lambda f, s, n, size, ok=True, **k: (f, s, k.get("cand", 0), n, size, ok, k.get("lossy", False), k.get("gain", 0.0), k.get("required", False), k.get("judged", False), k.get("promised", False), k.get("private", False))
    rows_ = [
        c(1, 0, "metadata", 110, required=True, private=True), c(1, 1, "small", 90), c(1, 1, "smaller", 80, ok=False, cand=1),
        c(2, 0, "a", 90), c(2, 1, "palette", 95, judged=True, lossy=True, gain=0.05), c(2, 2, "again", 88),
        c(3, 0, "palette", 95, judged=True, lossy=True, gain=0.05), c(3, 1, "again", 70),
        c(4, 0, "promised", 50, ok=False, promised=True), c(4, 1, "late", 10), c(5, 0, "metadata", None, required=True), c(6, 0, "larger", 120),
    ]
    originals = spark.createDataFrame([(k, 100) for k in range(1, 8)], "file_id long, size long")
    got = {r.file_id: r for r in selection.fold_stages(spark.createDataFrame(rows_, schema), originals).collect()}
    assert (got[1].size, got[1].steps, got[1].rejected) == (90, ["metadata", "small"], ["smaller"])
    assert (got[2].size, got[2].steps, got[2].is_lossy) == (90, ["a"], False)
    assert (got[3].size, got[3].steps, got[3].is_lossy) == (70, ["palette", "again"], True)
    assert got[4].aborted and got[4].size == 100 and got[5].aborted and got[6].size == 100 and got[6].steps == [] and got[7].size == 100


def test_metadata_rules(spark):
    f = lambda *x: spark.createDataFrame(list(x), "ns string, name string, text string")
    dc, exif = policy.NS["dc"], policy.NS["exif"]
    d = compare.diff(f((dc, "creator", "me"), (exif, "GPSLatitude", "1"), (dc, "title", "t")), f((exif, "GPSLatitude", "1"), (dc, "title", "u"), (dc, "x", "y")), ["ns", "name"], "text")
    got = {(r.name, r.rule) for r in compare.verify_metadata(policy.with_group(d), "private").collect()}
    assert got == {("creator", "rights lost"), ("GPSLatitude", "not removed"), ("title", "changed"), ("x", "invented")}


def test_reports(spark):
    schema = "file string, status string, reason string, originalSize long, size long, saved long, tools array<string>, result string, message string, rejected array<struct<step: string, reason: string, pixelsChanged: boolean>>"
    o = spark.createDataFrame([("a.png", "optimized", None, 100, 60, 40, ["x", "y"], "a.png", None, []), ("b.png", "unchanged", "alreadyOptimal", 50, 50, 0, [], None, None, [("s", "r", True)])], schema)
    got = sorted(r.json for r in report.records(o).collect())
    assert '"result"' not in got[0] and '"rejected"' not in got[0] and '"pixelsChanged":true' in got[1] and '"reason":"alreadyOptimal"' in got[1]
    assert tuple(report.summary(o).first()) == (0, 0, 40, 150, 0) and report.lines(o).first().line == "✓ a.png  −40.0 %  x + y"
    assert report.summary_line(report.summary(o)).first().line == "40 bytes saved (26.7 %)"


def test_planner_table_equals_planner(spark):
    facts = spark.createDataFrame([(1, "png", False, 80), (2, "jpeg", False, 95), (3, "jpeg", False, None), (4, "gif", False, None)], "file_id long, format string, is_animated boolean, jpeg_quality int")
    s = planner.Settings(lossy=True)
    got = {}
    for r in planner.candidates(facts, s).orderBy("file_id", "stage", "cand").collect():
        got.setdefault(r.file_id, []).append((r.stage, r.name))
    for f in facts.collect():
        want = [(i, c.name) for i, g in enumerate(planner.stages(f.format, {"is_animated": f.is_animated, "jpeg_quality": f.jpeg_quality}, s)) for c in g]
        assert got.get(f.file_id, []) == want


def test_codecs(spark):
    df = spark.createDataFrame([(1, b"no png")], "k long, content binary")
    assert codecs.run_codec(df, "redeflate", ["k"]).first().status == "failed" and codecs.run_codec(df, "nothing known", ["k"]).first().status == "unavailable"


def test_sequences_and_samples(spark):
    v = spark.createDataFrame([([0.0, 1.0, float("nan")], [0.0, 0.5, float("nan")]), ([1.0, 1.0, 1.0], [1.0, 2.0, float("nan")])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(compare.mean_difference(F.col("a"), F.col("b"))).collect()] == [round(0.5 / 3, 6), round(2 / 3, 6)]
    heif = spark.createDataFrame([(b"\0\0\0\x18ftypmif1avifheicheix",), (b"\0\0\0\x18ftypmif1\0\0\0\0heicheix",), (b"\0\0\0\x18ftypmif1avifmiafheix",)], "c binary")
    assert [r[0] for r in heif.select(admission.detect(F.col("c"), F.lit("png"))).collect()] == ["heic", "heic", "heic"]


def test_table_function_keeps_errors(spark):
    got = tables.iso_boxes(spark.createDataFrame([(1, b"junk"), (2, None), (3, b"\0\0\0\x08free")], "k long, content binary"), ["k"]).collect()
    assert {(r.k, r.kind, r.error is not None) for r in got} == {(1, None, True), (3, "free", False)}


def test_files_and_stream(spark, tmp_path):
    from mediaframe.sources import files
    from mediaframe.streaming import files as stream

    for name, data in (("a/x10.PNG", b"\x89PNG\r\n\x1a\n1234"), ("a/x9.png", b"12"), ("a/.h.png", b""), ("a/b.app/c.png", b""), ("a/t.txt", b"text")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = files.scan(spark, [str(tmp_path / "a")], named=[str(tmp_path / "a/t.txt"), str(tmp_path / "a/x9.png")])
    assert found.where("root IS NULL").count() == 1
    assert [r.path.rpartition("/")[2] for r in files.in_order(found).collect()] == ["t.txt", "x9.png", "x10.PNG"]
    assert files.every_nth(spark.range(10).repartition(3), 4, "id").count() == 3
    judged = stream.admitted(stream.arriving(spark, str(tmp_path / "a")))
    stream.run(judged, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"notAnImage", "damaged"}
    done = files.write_files(spark.createDataFrame([("d/e.bin", b"xyz")], "name string, content binary"), str(tmp_path / "w"))
    assert done.first().bytes == 3 and (tmp_path / "w/d/e.bin").read_bytes() == b"xyz"


def test_command_line():
    from mediaframe import cli

    assert cli.arguments(["x", "--output", "/o"]).settings.folder == "/o"
    for bad in (["x", "--to", "jxl", "--lossy"], ["x", "--suffix", "a", "--output", "b"], ["x", "--quality", "0"], ["x", "--suffix", " "]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_verify_without_rows_and_with_nulls(spark):
    kinds = "f int, kind int, data int, width int, height int, samples array<double>"
    none = spark.createDataFrame([], kinds)
    one = spark.createDataFrame([(1, 1, None, None, None, None)], kinds)
    assert verify.auxiliary_same(none, none, ["f"], True).count() == 0
    assert [tuple(r) for r in verify.auxiliary_same(one, one, ["f"], True).collect()] == [(1, True, 1)]
    assert [tuple(r) for r in verify.auxiliary_same(one, none, ["f"], False).collect()] == [(1, False, 0)]
    images = spark.createDataFrame([(1, 0, "a", "", True, True), (1, 1, "b", None, False, True)], "f int, n int, digest string, gap string, may_change boolean, gap_stays boolean")
    assert verify.images_violation(images, images, ["f"]).count() == 0
    assert [r.violation for r in verify.images_violation(images, images.where("n = 0"), ["f"]).collect()] == ["images lost or added"]
    a = F.array(*map(F.lit, (1, 2, 3, 0)))
    assert spark.range(1).select(verify.under_alpha(a, F.array()), verify.under_alpha(F.array(), F.array()), verify.under_alpha(F.lit(None).cast("array<int>"), a)).first()[:] == ("changed", "same", "changed")
    points = spark.createDataFrame([(1, 5), (2, None)], "f int, at int")
    changes = spark.createDataFrame([(1, 5, -2), (1, 6, 9)], "f int, e int, d int")
    assert sorted((r.f, r.moved) for r in verify.moved(points, "at", changes, "e", "d", ["f"]).collect()) == [(1, 3), (2, None)]
    assert verify.middle_and_upper(spark.createDataFrame([], "g int, s int, t int"), ["g"], "s", "t").count() == 0
