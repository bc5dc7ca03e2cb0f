import time
import zipfile

import pytest

from pyspark.sql import functions as F

from fieldcast.operators import monitor
from fieldcast.sources import draw_files, files, manifest, products, workbook

WORKBOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
 <sheets><sheet name="a" sheetId="1" r:id="rId1"/><sheet name="b" sheetId="2" r:id="rId2"/></sheets></workbook>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
 <Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>"""
SHARED = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
 <si><t>name</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>"""
SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>"""


def write_book(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", WORKBOOK)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(""))
        z.writestr("xl/worksheets/sheet2.xml", SHEET.format(rows))


def test_workbooks_of_a_folder(spark, tmp_path):
    title = '<row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>'
    header = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>n</t></is></c></row>'
    data = '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>8</v></c><c r="C3"><v>3.5</v></c></row><row r="4"><c r="C4"><v>4</v></c></row>'
    write_book(tmp_path / "保守-23年 04月.xlsx", title + header + data)
    swapped = '<row r="2"><c r="A2" t="inlineStr"><is><t>n</t></is></c><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="A3"><v>9</v></c></row>'
    write_book(tmp_path / "保守-23年 05月.xlsx", title + swapped)
    write_book(tmp_path / "other.xlsx", title + header + data)
    df = workbook.read_sheets(spark, str(tmp_path), "^保守", ["name", "n", "...2", "none"], sheet=2, skip=1)
    rows = sorted(tuple(r)[1:] for r in df.na.fill("-").collect())
    assert rows == [("-", "4", "-", "-"), ("-", "9", "-", "-"), ("hello", "3.5", "8", "-")]
    tags = df.select(files.period_of(df.source_file, r"-(\d\d)年 (\d\d)月").alias("p")).distinct()
    assert sorted(r.p for r in tags.collect()) == ["2304", "2305"]
    assert files.list_files(spark, str(tmp_path), "^保守").count() == 2


def test_code_page_and_tsv(spark, tmp_path):
    (tmp_path / "周辺機.csv").write_bytes("機番\tデバイスコード\n1\tｱﾀﾞﾌﾟﾀ  \n2\tNA\n".encode("cp932"))
    rows = files.read_code_page(spark, str(tmp_path), "`機番` string, `デバイスコード` string", "*.csv").collect()
    assert [tuple(r) for r in rows] == [("1", "ｱﾀﾞﾌﾟﾀ  "), ("2", None)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("2304", 1, "a"), ("2305", None, "b")], "period string, n int, s string")
    files.write_tsv(df, out, ["period"])
    back = files.read_tsv(spark, out, "n int, s string, period string")
    assert sorted((r.period, r.n or 0, r.s) for r in back.collect()) == [("2304", 1, "a"), ("2305", 0, "b")]


@pytest.mark.parametrize("split", [None, "200"])
def test_draw_files(spark, tmp_path, split):
    for chain in (1, 2):
        lines = ["# sampler header", "lp__,s_z,mu.1,y.1.2"]
        lines += [f"-1.0,{chain}.5,{i},{chain * 100 + i}" for i in range(1, 41)]
        lines.insert(5, "# adaptation finished")
        (tmp_path / f"model-{chain}.csv").write_text("\n".join(lines) + "\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        draws = draw_files.read_draw_files(spark, str(tmp_path)).cache()
        assert draws.count() == 2 * 40 * 3
        mu = draws.where("variable = 'mu'").collect()
        assert all(r.value == r.iteration and r.i1 == 1 and r.i2 is None for r in mu)
        y = draws.where("variable = 'y' and chain = 2").collect()
        assert all(r.value == 200 + r.iteration and r.draw == 40 + r.iteration and r.i2 == 2 for r in y)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = str(tmp_path / "stored")
    draw_files.write_draws(draws, out, "r1")
    back = draw_files.read_draws(spark, out, "r1", ["s_z"])
    assert back.count() == 80
    assert "PartitionFilters: [isnotnull(variable" in back._jdf.queryExecution().executedPlan().toString()
    draws.unpersist()


def test_wide_draw_files_plan_quickly(spark, tmp_path):
    """A hundred thousand columns are a plan like any other."""
    names = ["lp__", *[f"mu.{i}" for i in range(1, 100_001)]]
    rows = [",".join(["0", *[str(i + t) for i in range(1, 100_001)]]) for t in (1, 2)]
    (tmp_path / "wide-1.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    draws = draw_files.read_draw_files(spark, str(tmp_path))
    begin = time.time()
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert time.time() - begin < 5 and len(plan) < 50_000
    assert draws.count() == 200_000 and draws.where("value <> i1 + iteration").isEmpty()


def test_products(spark, tmp_path):
    df = spark.createDataFrame(
        [("x", "2023-03-01", 1.0, 2.0, 3.0, True)],
        "series string, date string, lwr double, fit double, upr double, is_future boolean",
    ).selectExpr("series", "cast(date as date) date", "lwr", "fit", "upr", "is_future")
    path = str(tmp_path / "f")
    for _ in range(2):  # a repeated run is one run
        products.write_forecast(df, path, "r1", F.lit("2023-02-01").cast("date"))
    assert products.read_forecast(spark, path, "r1").count() == 1
    with products.recorded_run(spark, str(tmp_path / "runs"), "r1", "title"):
        pass
    with products.recorded_run(spark, str(tmp_path / "runs"), "r1", "again"):
        pass
    assert [r.title for r in products.read_records(spark, str(tmp_path / "runs")).collect()] == ["again"]


def test_runs_are_seen_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(100).withColumn("part", F.col("id") % 3)
    manifest.write_run(rows, path, "a", ["part"])
    # stopped after its files, stopped inside its files, stopped inside the commit
    manifest.write_attempt(rows, path, ["part"])
    broken = F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="stop"):
        manifest.write_run(rows.withColumn("id", broken.cast("long")), path, "b", ["part"])
    (tmp_path / "runs" / "commits" / "x" / "_temporary" / "0").mkdir(parents=True)
    assert sorted(r.id for r in manifest.read_run(spark, path, "a").collect()) == list(range(100))
    with pytest.raises(ValueError):
        manifest.read_run(spark, path, "b")
    # two writers of one run at once, and a reader between the commits
    first, second = (manifest.write_attempt(rows.limit(n), path, ["part"]) for n in (5, 7))
    manifest.commit(spark, path, "b", first)
    assert manifest.read_run(spark, path, "b").count() == 5
    manifest.commit(spark, path, "b", second)
    manifest.write_run(rows.limit(5), path, "b2", ["part"])
    assert manifest.read_run(spark, path, "b").count() == 7
    counts = {r.run_id: r["count"] for r in manifest.read_runs(spark, path).groupBy("run_id").count().collect()}
    assert counts == {"a": 100, "b": 7, "b2": 5}


def test_overlay_takes_the_newest_run_made_before_a_day(spark, tmp_path):
    path = str(tmp_path / "f")
    day = lambda n: f"2023-03-{n:02d}"
    for run, made, days in (("r1", 1, range(2, 8)), ("r2", 4, range(4, 8)), ("r3", 4, range(5, 7)), ("r1", 1, range(2, 9))):
        rows = [("x", day(d), float(made), 9.0, 9.0, True) for d in days]
        df = spark.createDataFrame(rows, "series string, d string, lwr double, fit double, upr double, is_future boolean")
        df = df.withColumn("date", F.col("d").cast("date")).drop("d")
        products.write_forecast(df, path, run, F.lit(day(made)).cast("date"))
    chosen = monitor.as_of(products.read_forecasts(spark, path))
    assert {r.date.day: r.run_id for r in chosen.collect()} == {
        2: "r1", 3: "r1", 4: "r1", 5: "r3", 6: "r3", 7: "r2", 8: "r1"}
    actuals = spark.createDataFrame([("x", day(d), 0) for d in (1, 5, 8)], "series string, d string, em long")
    judged = monitor.overlay(actuals.withColumn("date", F.col("d").cast("date")), chosen)
    assert {(r.date.day, r.run_id, r.breach) for r in judged.collect()} == {(5, "r3", True), (8, "r1", True)}
