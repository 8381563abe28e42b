"""Spreadsheets, the result sink over restarts and replays, and runs that close by count or time."""

import zipfile

import pytest
from pyspark.sql import functions as F

from pricelens.sources import result_sink, spreadsheets
from pricelens.streaming import progress

SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, shared=True):
    """A workbook of ``{name: rows}``; texts shared or inline, numbers as they are, None left out."""
    texts = sorted({c for rows in sheets.values() for r in rows for c in r if isinstance(c, str)})

    def cell(n, i, value):
        at = f"{chr(65 + i) if i < 26 else 'A' + chr(39 + i)}{n}"
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if not isinstance(value, str):
            return f'<c r="{at}"><v>{value}</v></c>'
        safe = value.replace("&", "&amp;").replace("<", "&lt;")
        return f'<c r="{at}" t="s"><v>{texts.index(value)}</v></c>' if shared else f'<c r="{at}" t="inlineStr"><is><r><t>{safe[:1]}</t></r><r><t>{safe[1:]}</t></r></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEETS}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEETS}">' + "".join("<si><t>" + t.replace("&", "&amp;").replace("<", "&lt;") + "</t></si>" for t in texts) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{n}">' + "".join(cell(n, k, c) for k, c in enumerate(r) if c is not None) + "</row>" for n, r in enumerate(rows, 1) if r)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{SHEETS}"><sheetData>{body}</sheetData></worksheet>')


@pytest.mark.parametrize("shared", [True, False])
def test_spreadsheets(spark, tmp_path, shared):
    many = {f"S{i}": [["SKU", " Product Name "], [1, f"A & <B> {i}"], [None, None], [2.5, " "], [True, "last"]] for i in range(9)}
    workbook(tmp_path / "a.xlsx", many | {"alone": [["x"], ["y"], []], "none": [["a", "b"], ["c", "d"]], "empty": []}, shared)
    workbook(tmp_path / "b.xlsm", {"long": [["title", *[None] * 27, "wide"]] + [[f"n{i}"] for i in range(9000)]}, shared)
    spark.dataSource.register(spreadsheets.SheetSource)
    cells = spark.read.format("sheets").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 13
    first = [(r.row_number, r.cells) for r in cells.where("sheet = 'S3'").orderBy("row_number").collect()]
    assert first == [(1, ["SKU", " Product Name "]), (2, ["1", "A & <B> 3"]), (3, []), (4, ["2.5", " "]), (5, ["true", "last"])]
    wide = cells.where("sheet = 'long' AND row_number = 1").first().cells
    assert len(wide) == 29 and wide[28] == "wide" and wide[1] is None
    names = spreadsheets.sheet_names(cells)
    assert names.where("sheet = 'long'").count() == 9000 and names.where("sheet in ('none', 'empty')").count() == 0
    assert [(r.sheet, r.name) for r in names.where("sheet in ('S1', 'alone')").orderBy("sheet", "row_number").collect()] == [("S1", "A & <B> 1"), ("S1", "last"), ("alone", "y")]
    assert spark.read.format("sheets").option("sheet", "S2").load(f"file://{tmp_path}/a.xlsx").count() == 5


def test_uploads_by_ending_and_bytes(spark, tmp_path):
    workbook(tmp_path / "upload", {"one": [["Name"], ["Probe"]], "two": [["Name"], ["Other"]]})
    head = (tmp_path / "upload").read_bytes()[:8]
    assert [r.name for r in spreadsheets.read_uploaded(spark, str(tmp_path / "upload"), head).collect()] == ["Probe"]
    (tmp_path / "list.csv").write_text("﻿Name,Code\n Mirror ,1\n,2\n")
    assert [r.name for r in spreadsheets.read_uploaded(spark, str(tmp_path / "list.csv"), b"PK").collect()] == ["Mirror"]
    (tmp_path / "plain").write_text("Bur\nFile\n")
    assert [r.name for r in spreadsheets.read_uploaded(spark, str(tmp_path / "plain"), b"Bur\nFile").collect()] == ["Bur", "File"]
    with pytest.raises(ValueError):
        spreadsheets.read_uploaded(spark, str(tmp_path / "old"), b"\xd0\xcf\x11\xe0....")


ITEMS = "run_id string, idx int, note string, finished_at string"


def test_sink_replays_change_nothing(spark, tmp_path):
    save = result_sink.write_batch(f"{tmp_path}/rows", "finished_at")
    one = spark.createDataFrame([("r", 0, "a", "1"), ("r", 1, "b", "2"), ("r", 1, "b2", "3"), (None, 1, "x", "4"), ("s", 0, "c", "5")], ITEMS)
    two = spark.createDataFrame([("r", 0, "a2", "0")], ITEMS)
    save(one, 0), save(two, 1)

    def now():
        written = result_sink.arrivals(spark, f"{tmp_path}/rows")
        return sorted((r.run_id, r.idx, r.note) for r in result_sink.saved_items(written).collect()), sorted(tuple(r) for r in result_sink.done_counts(written).collect()), written.count()

    want = ([("r", 0, "a2"), ("r", 1, "b2"), ("s", 0, "c")], [("r", 2), ("s", 1)], 6)
    assert now() == want
    save(one.limit(2), 0)  # a try that broke off
    save(one, 0)
    save(two, 1)
    save(one.limit(0), 7)
    assert now() == want
    lines = [r.value for r in result_sink.as_lines(result_sink.arrivals(spark, f"{tmp_path}/rows")).collect()]
    assert lines[0] == '{"index":0,"run_id":"r","note":"a","finished_at":"1"}' and len(lines) == 6 and '"a2"' in lines[-1]


def test_sink_goes_on_after_a_restart(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("r", 0, "a", "1")], ITEMS).coalesce(1).write.json(source)
    stream = lambda: spark.readStream.schema(ITEMS).json(source)
    result_sink.stream_results(stream(), f"{tmp_path}/rows", f"{tmp_path}/log").awaitTermination()
    spark.createDataFrame([("r", 1, "b", "2"), ("r", 0, "a2", "3")], ITEMS).coalesce(1).write.mode("append").json(source)
    for _ in range(2):  # the second finds nothing new
        result_sink.stream_results(stream(), f"{tmp_path}/rows", f"{tmp_path}/log").awaitTermination()
    # the last batch is open again, as after a crash before its commit
    import glob
    import os

    for name in glob.glob(f"{tmp_path}/log/commits/*1*"):
        os.remove(name)
    for name in glob.glob(f"{tmp_path}/log/commits/.*1*"):
        os.remove(name)
    result_sink.stream_results(stream(), f"{tmp_path}/rows", f"{tmp_path}/log").awaitTermination()
    written = result_sink.arrivals(spark, f"{tmp_path}/rows")
    assert sorted((r.idx, r.note, r.batch) for r in result_sink.saved_items(written).collect()) == [(0, "a2", 1), (1, "b", 1)] and written.count() == 3
    assert result_sink.done_counts(written).collect()[0].done_count == 2


RUNS = "run_id string, idx int, ok boolean, expected int, at timestamp"


def test_runs_close_by_count_or_time(spark, tmp_path):
    for k, v in progress.STORE.items():
        spark.conf.set(k, v)
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    first = [("full", 1, True, 3, day(1)), ("full", 0, False, 3, day(2)), ("full", 0, True, 3, day(1)), ("slow", 0, True, 2, day(1)), ("gone", 0, False, 2, day(1)), (None, 1, True, 1, day(1))]
    second = [("full", 2, True, 3, day(3)), ("slow", 1, False, 2, day(9)), ("open", 0, True, 2, day(20)), ("open", 0, False, 2, day(19))]
    try:
        for k, rows in enumerate((first, second)):
            spark.createDataFrame([(r, i, o, e, t) for r, i, o, e, t in rows], "run_id string, idx int, ok boolean, expected int, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(RUNS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        got = progress.run_progress(stream, "10 days", "1 day")
        query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = sorted((r.run_id, r.outcome, r.expected, r.done, r.failed) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert rows == [("full", "complete", 3, 3, 1), ("gone", "timed out", 2, 1, 1), ("slow", "complete", 2, 2, 1)]
        batch = spark.read.schema(RUNS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        assert sorted((r.run_id, r.outcome, r.expected, r.done, r.failed) for r in progress.run_progress_batch(batch, "10 days", "1 day").collect()) == rows
    finally:
        for k in progress.STORE:
            spark.conf.unset(k)
