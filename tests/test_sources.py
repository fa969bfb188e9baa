from __future__ import annotations

import zipfile
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aforetime import sinks
from aforetime.functions import clocks
from aforetime.sources import files, pages

from aforetime.streaming import streams

HEAD = "KEY,FREQ,TIME_PERIOD,OBS_VALUE,UNIT,ACTION,VALID_FROM,VALID_TO\n"


def test_versioned_series(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        "﻿" + HEAD + "K,M,2020-01,1.5,P,Replace,2020-02-01T10:00:00Z,\nK,M,2020-01,,P,Delete,,2020-03-01T10:00:00Z\nK,M,2020-02,--,P,Replace,2020-03-01T10:00:00Z,\nK,M,2020-03,2,P,Replace,,\n"
    )
    rows = files.versioned_series(spark, str(path)).collect()
    assert len(rows) == 2
    assert {(r["period"], r["value"], r["is_delete"]) for r in rows} == {
        (date(2020, 1, 1), 1.5, False), (date(2020, 1, 1), None, True)
    }
    counts = files.series_violations(spark, str(path), "2020-01", "2020-02").first()
    assert (counts["n_rows"], counts["n_keys"], counts["outside_periods"], counts["unusable_values"]) == (4, 1, 1, 1)


def test_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "s.csv").write_text("KEY,OTHER\n1,2\n")
    with pytest.raises(files.SchemaMismatch):
        files.versioned_series(spark, str(tmp_path / "s.csv"))


def test_wide_vintages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("monthly_200202.csv", "x,one,two\nkey,A,B\nu,,\nv,,\nJan-01,1.0,2.0\nJan-99,3.0,-\nnothing,1,1\n")
        z.writestr("notes.txt", "no")
    rows = files.wide_vintages(spark, str(tmp_path / "a.zip"), "B").collect()
    assert [
        (r["vintage"], r["period"], r["value"], r["usable_day"]) for r in rows
    ] == [(date(2002, 2, 1), date(2001, 1, 1), 2.0, date(2002, 3, 1))]
    assert {
        r["period"] for r in files.wide_vintages(spark, str(tmp_path / "a.zip"), "A").collect()
    } == {date(2001, 1, 1), date(1999, 1, 1)}


def test_pages(spark):
    html = "<p>3 February 2003</p><a>Rates: January 2003</a><p>x</p><p>5 March 2003</p><a>Rates: February 2003</a>"
    table = "<table><tr><th>Year</th><th>Day</th><th>Rate</th></tr><tr><td>2003</td><td>6 Jun.</td><td>1.00<sup>1</sup></td></tr><tr><td></td><td>7 Mar.</td><td>−1.50</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, table)], "page_id long, html string")
    found = pages.release_dates(df, "Rates").collect()
    assert {(r["period"], r["release_day"]) for r in found} == {
        (date(2003, 1, 1), date(2003, 2, 3)), (date(2003, 2, 1), date(2003, 3, 5))
    }
    rates = pages.effective_rates(df).collect()
    assert {(r["effective"], r["rate"]) for r in rates} == {
        (date(2003, 6, 6), Decimal("1.0000")), (date(2003, 3, 7), Decimal("-1.5000"))
    }


def test_clocks(spark):
    days = spark.createDataFrame([(date(2022, 6, 9),), (date(2022, 7, 21),), (date(2025, 10, 25),)], "d date")
    shown = [
        r[0] for r in days.select(
            F.unix_seconds(clocks.decision_instant(F.col("d"), "2022-07-21", (13, 45), (14, 15), "Europe/Berlin"))
        ).collect()
    ]
    assert shown[:2] == [
        int(datetime(2022, 6, 9, 11, 45, tzinfo=timezone.utc).timestamp()),
        int(datetime(2022, 7, 21, 12, 15, tzinfo=timezone.utc).timestamp())
    ]
    nexts = [r[0] for r in days.select(clocks.next_business_day(F.col("d"))).collect()]
    assert nexts == [date(2022, 6, 10), date(2022, 7, 22), date(2025, 10, 27)]
    months = clocks.month_calendar(spark, "2020-01-01", "2020-03-01", "Europe/Berlin", month_end=True).collect()
    assert len(months) == 3


def test_sinks_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    sinks.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, str(tmp_path / "out"))
    listed = sinks.manifest(df, str(tmp_path / "out"))
    assert files.verify_inventory(spark, str(tmp_path / "out"), listed).count() == 0
    wrong = listed.withColumn("sha256", F.lit("00")).unionByName(
        spark.createDataFrame([("gone", 1, "x"), ("../up", 1, "x")], listed.schema)
    )
    assert {
        r["failure"] for r in files.verify_inventory(spark, str(tmp_path / "out"), wrong).collect()
    } == {"hash", "missing", "path_escape"}
    assert [r["line"] for r in sinks.canonical_lines(df, ["k"]).collect()] == ['{"k":1,"v":null}', '{"k":2,"v":"b"}']


def test_streams(spark, tmp_path):
    start = datetime(2020, 1, 1, tzinfo=timezone.utc)
    flags = [False, True, True, True, False, True, False, False, False, True]
    rows = [("a", start + timedelta(hours=i), float(i), f) for i, f in enumerate(flags)]
    schema = "k string, t timestamp, v double, b boolean"
    source = tmp_path / "in"
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(str(source))

    def run(build, name, mode):
        stream = build(spark.readStream.schema(schema).parquet(str(source)))
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / name)
        ).start()
        query.awaitTermination()
        return spark.table(name).collect()

    alerts = run(lambda s: streams.breach_alerts(s.dropDuplicates(), "k", "t", "b"), "alerts", "append")
    assert [r["alert"] for r in sorted(alerts, key=lambda r: r["t"])] == ["opened", "closed"]
    assert len(run(lambda s: streams.unrepeated(s, ["k"], "t", "1 day"), "once", "append")) == len(rows)
    levels = run(
        lambda s: streams.windowed_levels(s, ["k"], "t", "v", window="5 hours", lateness="1 hour"), "levels",
        "complete"
    )
    assert sum(r["n"] for r in levels) == len(rows) + 1


def test_workbook_cells(spark, tmp_path):
    from aforetime.sources.workbooks import workbook_cells

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr(
            "xl/sharedStrings.xml",
            f"<sst {main}><si><t>date</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>"
        )
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
        )
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>4.5</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
        )
    rows = workbook_cells(spark, str(tmp_path / "b.xlsx")).select("sheet", "row_no", "column_no", "text").collect()
    assert {tuple(r) for r in rows} == {
        ("One", 0, 0, "date"), ("One", 0, 27, "value"), ("One", 2, 0, "4.5"), ("One", 2, 1, "x")
    }


def test_nested_files_keep_their_paths(spark, tmp_path):
    for part in ("a", "b/c"):
        (tmp_path / "in" / part).mkdir(parents=True)
        (tmp_path / "in" / part / "x.csv").write_text(part)
    listed = files.file_hashes(spark, str(tmp_path / "in")).select(
        files.relative_path(spark, str(tmp_path / "in")).alias("relative_path"), "length", "sha256"
    )
    assert {r[0] for r in listed.collect()} == {"a/x.csv", "b/c/x.csv"}
    assert files.verify_inventory(spark, str(tmp_path / "in"), listed).count() == 0
    twice = listed.unionByName(listed.where("relative_path = 'a/x.csv'"))
    assert [tuple(r) for r in files.verify_inventory(spark, f"file://{tmp_path}/in/", twice).collect()] == [("a/x.csv", "repeated")]
    df = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    sinks.write_once(df, str(tmp_path / "out"), partition_by=("v",))
    assert {r[0].split("/")[0] for r in sinks.manifest(df, str(tmp_path / "out")).collect()} == {"v=b", "v=c"}


def test_archive_entries_and_identifier_periods(spark):
    good = '<dt isoDate="2004-05-07">7 May 2004</dt><dd><div class="box title"><a href="/r0404.html">Report <b>one</b></a></div></dd>'
    wrong = '<dt isodate="2004-06-08">9 June 2004</dt><dd><div class="title"><a href="/x">Two</a></div></dd>'
    bare = '<DT isoDate="2004-07-09"> 9 July 2004 </DT><dd><div class="subtitle"><a href="/y">Three</a></div></dd>'
    scanned = spark.createDataFrame([("p", f"<dl>{good}{wrong}{bare}<dtx></dl>"), ("q", "<p>none</p>"), ("r", None)], "page_id string, html string")
    found = [tuple(r) for r in pages.archive_entries(scanned).orderBy("entry_no").collect()]
    assert found == [
        ("p", 1, date(2004, 5, 7), "/r0404.html", "Report one", None), ("p", 2, date(2004, 6, 8), "/x", "Two", "date"),
        ("p", 3, date(2004, 7, 9), None, None, "title"),
    ]
    codes = [("0404", date(2004, 5, 7)), ("0405", date(2004, 5, 7)), ("0312", date(2004, 1, 9)), ("0212", date(2004, 1, 9)), ("0413", date(2005, 1, 1)), (None, None)]
    df = spark.createDataFrame(codes, "c string, d date")
    periods = [r[0] for r in df.select(pages.identifier_period(F.col("c"), F.col("d"))).collect()]
    assert periods == [date(2004, 4, 1), None, date(2003, 12, 1), None, None, None]
