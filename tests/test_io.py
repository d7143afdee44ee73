import io
import zipfile

from pyspark.sql import functions as F

from lodestrata.sources import files, store
from lodestrata.streaming import events


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def xlsx(path):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = f'<row>{cell("A1", "name")}{cell("B1", "level")}</row><row>{cell("A2", "Wall")}{cell("B2", "5A")}</row><row>{cell("A3", " ")}</row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="Xi" r:id="r1"/><sheet name="No" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("云南".encode("gbk"))
    (tmp_path / "b.txt").write_text("plain")
    docx(tmp_path / "c.docx")
    xlsx(tmp_path / "d.xlsx")
    (tmp_path / "e.xlsx").write_bytes(b"broken")
    (tmp_path / "f.docx").write_bytes(b"broken")
    found = files.binary(spark, str(tmp_path))
    assert {r["path"][-5:]: r["route"] for r in found.collect()}["a.txt"] == "text"
    texts = {r["path"][-5:]: r["text"] for r in files.text(found.where("kind = 'txt'")).collect()}
    assert texts == {"a.txt": "云南", "b.txt": "plain"}
    words = {r["path"][-6:]: r["text"] for r in files.word_documents(found).collect()}
    assert words == {"c.docx": "# c\n\n## Title\nText\n| a | b |\n|---|---|", "f.docx": ""}
    assert [tuple(r)[1:] for r in files.spreadsheets(found).collect()] == [("Xi", 0, "Xi-第2行", "name: Wall\nlevel: 5A")]


def test_csv_and_logs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n01,2.50\n")
    assert files.csv(spark, str(tmp_path / "t.csv")).first().asDict() == {"a": "01", "b": "2.50"}
    store.append_log(spark.createDataFrame([("x", 1)], "host string, n int"), str(tmp_path / "log"))
    store.append_log(spark.createDataFrame([("y", 2)], "host string, n int"), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "log"), "host string, n int").collect())) == [("x", 1), ("y", 2)]
    assert files.json_lines(spark, str(tmp_path / "log"), "host string, n int", holds='"y"').count() == 1


def test_store(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda xs: spark.createDataFrame(xs, "content string, file string")
    store.replace_by_key(rows([("a", "f"), ("b", "f"), ("c", "g")]), path, "file")
    store.replace_by_key(rows([("d", "f")]), path, "file")
    store.replace_by_key(rows([("d", "f")]), path, "file")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("c", "g"), ("d", "f")]
    assert store.revoke(spark, path, "file", "f") == (1, 1)
    assert store.revoke(spark, path, "file", "none") == (0, 1)
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, p string, q string")
    assert sorted(map(tuple, store.upserted(old, new, "id").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    filled = store.backfilled(spark.createDataFrame([("",), (None,), ("k",)], "r string"), "r", F.lit("new"))
    assert [r[0] for r in filled.collect()] == ["new", "new", "k"]
    listed = store.listing(rows([("a", "f")]), rows([("a", "g"), ("b", "g")]), "file")
    assert sorted(map(tuple, listed.collect())) == [("f", 1, 0), ("g", 0, 2)]


def test_breaker_keeps_state_over_batches(spark, tmp_path):
    path, schema = tmp_path / "in", "event_id long, ts timestamp, ok boolean, k string"
    times = [(i, f"2024-01-01 00:00:{10 + i:02d}", False) for i in range(5)] + [(5, "2024-01-01 00:00:20", True), (6, "2024-01-01 00:01:15", False), (7, "2024-01-01 00:01:16", True), (8, "2024-01-01 00:02:30", True), (9, "2024-01-01 00:02:31", True)]
    for n, part in enumerate((times[:4], times[4:])):
        spark.createDataFrame([(*t, "a") for t in part], "event_id long, ts string, ok boolean, k string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(path))
    stream = events.read_files(spark, str(path), schema)
    got = events.drain(events.breaker(stream, "k"), str(tmp_path / "out")).orderBy("event_id").collect()
    assert [r["state"] for r in got] == ["closed"] * 5 + ["open", "half_open", "open", "half_open", "closed"]


def test_rate_limit_over_files_whose_times_interleave(spark, tmp_path):
    files = [[(1, "10:10"), (2, "11:10"), (3, "10:50")], [(4, "11:20"), (5, "10:05"), (6, "11:30")], [(7, "10:00"), (8, "11:05")], [(9, "16:00")]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(n, "a") for n, _ in rows], "event_id long, k string").join(spark.createDataFrame([(n, f"2024-01-01 {t}:00") for n, t in rows], "event_id long, t string"), "event_id")
        df.select("event_id", "k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    want = {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True}
    for late in (None, "3 hours"):
        stream = events.read_files(spark, str(tmp_path / "in"), schema)
        got = events.drain(events.limited(stream, "k", 2, 3600, late), str(tmp_path / f"out-{late}")).collect()
        found = {r["event_id"]: r["accepted"] for r in got}
        assert len(found) == len(got)
        assert found == (want if late else {i: x for i, x in want.items() if not x})


def test_revoke_takes_names_that_file_systems_dislike(spark, tmp_path):
    path = str(tmp_path / "odd")
    names = ["a:b.md", "x/../y", "it's", "back\\slash", "é 空", "plain", "100%"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(50, "a:b.md")], "id long, file string")
    store.replace_by_key(rows, path, "file")
    left = len(names) + 1
    for n in names[:-1]:
        gone = 2 if n == "a:b.md" else 1
        left -= gone
        assert store.revoke(spark, path, "file", n) == (gone, left)
        assert sorted(r["file"] for r in spark.read.schema(rows.schema).parquet(path).collect()) == sorted(names[names.index(n) + 1 :])
    assert store.revoke(spark, path, "file", "../odd") == (0, 1)


def test_marks_are_used_once_and_expire(spark, tmp_path):
    """Over files whose times interleave, with a row that is too late, and again after a restart."""
    sets = {1, 3, 5, 6, 9, 12}
    files = [[(1, "a", "10:00"), (3, "a", "10:20"), (5, "b", "10:00")], [(2, "a", "10:10"), (6, "a", "11:10"), (4, "a", "10:30"), (8, "b", "10:31")], [(7, "a", "11:40"), (9, "a", "12:00"), (10, "b", "15:00")]]
    write = lambda rows: spark.createDataFrame([(i, k, f"2024-01-01 {t}:00") for i, k, t in rows], "event_id long, k string, t string").select("event_id", "k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for rows in files[:2]:
        write(rows)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: events.drain(events.pending_marks(events.read_files(spark, str(tmp_path / "in"), schema), "k", F.col("event_id").isin(*sets), 1800, "2 hours"), str(tmp_path / "out"), timers=True)
    assert run().count() == 0  # the watermark is at 9:10
    write(files[2])
    want = {1: False, 2: True, 3: False, 4: True, 5: False, 8: False, 6: False, 7: True, 9: False}  # the mark of 5 has expired when 8 comes
    assert {r["event_id"]: r["pending"] for r in run().collect()} == want
    write([(11, "a", "12:10"), (12, "c", "20:00")])  # 11 is too late by then
    assert {r["event_id"]: r["pending"] for r in run().collect()} == want | {10: False}


def test_rate_limit_gives_every_row_out(spark, tmp_path):
    """Also those of hours that no watermark has passed, of no time and of no key; an acceptance is taken back when an earlier row comes."""
    files = [[(1, "a", "10:10:00"), (2, "a", "10:59:59.7"), (3, "a", "10:50:00"), (9, None, "10:00:00"), (10, "a", None)], [(4, "a", "11:20:00"), (5, "a", "10:05:00"), (6, "a", "11:30:00")], [(7, "a", "10:00:00"), (1, "a", "10:10:00")]]
    for rows in files:
        df = spark.createDataFrame([(i, k, t and f"2024-01-01 {t}") for i, k, t in rows], "event_id long, k string, t string")
        df.select("event_id", "k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    clock = F.rint(F.unix_micros("ts") / F.lit(1_000_000))
    for name, by, eleven in (("clock", clock, {2: True, 4: True, 6: False}), ("time", None, {2: False, 4: True, 6: True})):
        out = events.drain(events.limit_changes(events.read_files(spark, str(tmp_path / "in"), schema), "k", 2, 3600, by), str(tmp_path / name))
        got = sorted((r["event_id"], r["accepted"]) for r in events.settled(out).collect())
        assert got == sorted([(1, False), (1, False), (3, False), (5, True), (7, True), (9, True), (10, True), *eleven.items()])


def test_all_that_is_due_goes_through_at_once():
    import pandas as pd

    hour, life = 3_600_000_000, 1_800_000_000
    held = pd.DataFrame([("a" if i % 2 else None, i // 2 * hour // 4, i, i % 3 == 0) for i in range(400)], columns=["key", "us", "id", "sets"])
    marks = pd.DataFrame([(None, -life // 2), ("a", -2 * life), ("b", 0), ("c", 49 * hour)], columns=["key", "us"])
    out, later, left = events._due(held.sample(frac=1, random_state=1), marks, life, 48 * 3_600_000)
    want, mark = {}, {None: -life // 2, "a": -2 * life}
    for k, us, ident, sets in held.itertuples(index=False):
        if us < 47.5 * hour:
            want[ident] = mark.get(k) is not None and us - mark[k] <= life
            mark[k] = us if sets else None
    assert dict(zip(out["id"], out["pending"])) == want and len(out) + len(later) == 400
    assert {k: us for k, us in left.itertuples(index=False) if k} == {k: us for k, us in (("a", mark["a"]), ("c", 49 * hour)) if us is not None}
