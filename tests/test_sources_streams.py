import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.sources import files, paged
from quaestor.streaming import windows

CODES = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("amount", T.LongType())])


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿code,name,amount\n001,"a ""b""\nc",5\n\n002,,\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(path), CODES).orderBy("code").collect()] == [("001", 'a "b"\nc', 5), ("002", "", None)]
    path.write_text("code,amount,name\n")
    with pytest.raises(files.Malformed):
        files.read_csv(spark, str(path), CODES)


def test_json_and_payload(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"id": 1, "topics": [{"slug": "a"}, {"slug": "b"}]}))
    schema = T.StructType.fromDDL("id long, topics array<struct<slug:string>>")
    rows = files.read_json(spark, str(tmp_path / "t.json"), schema)
    assert [r.slug for r in files.exploded(rows, "id", "topics").collect()] == ["a", "b"]
    with pytest.raises(files.Malformed):
        files.read_json(spark, str(tmp_path / "t.json"), T.StructType.fromDDL("id long"))
    payload = spark.createDataFrame([(json.dumps({"items": [{"k": 1}, {"k": 2}], "docs": []}),)], "p string")
    got = files.imported(payload, "p", {"items": "struct<k:int>", "docs": "struct<x:string>"}, F.lit("d1"))
    assert [(r.dataset_id, r.k) for r in got["items"].collect()] == [("d1", 1), ("d1", 2)] and got["docs"].count() == 0


def test_file_sets(spark, tmp_path):
    for name, body in (("items.csv", b"old"), ("items (1).csv", b"new"), ("other.csv", b"new")):
        (tmp_path / name).write_bytes(body)
    assert files.candidates(spark, str(tmp_path), "items.csv").count() == 2
    assert files.resolve(spark, str(tmp_path), "items.csv", hashlib.sha256(b"new").hexdigest()).replace("%20", " ").endswith("items (1).csv")
    with pytest.raises(files.Malformed):
        files.resolve(spark, str(tmp_path), "items.csv", "0" * 64)


def test_seed_and_transcript(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,tags,note\n1,"[""a"",""b""]",\n')
    assert tuple(files.read_seed(spark, str(tmp_path / "s.csv"), ("tags",)).first()) == ("1", ["a", "b"], None)
    sessions = spark.createDataFrame([(1,), (2,)], "s long")
    messages = spark.createDataFrame([(1, 2, "=b\tc"), (1, 1, "a\nb")], "s long, at long, text string")
    rows = files.transcript(sessions, messages, "s", "at", "text").orderBy("s", "message_order").collect()
    assert [(r.s, r.message_order, r.text) for r in rows] == [(1, 1, "a b"), (1, 2, "'=b c"), (2, None, "")]
    files.write_tsv(spark.createDataFrame([("x", "y")], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).first().b == "y"


def one_file(folder):
    return b"".join(f.read_bytes() for f in sorted(folder.glob("part-*.csv"))).decode()


def test_dataset_of_a_manifest(spark, tmp_path):
    bodies = {"items.csv": b"code,name,amount\n01,a,5\n02,b,\n", "topics.json": b'[{"id": 1}, {"id": 2}, {"id": 3}]'}
    for name, body in bodies.items():
        (tmp_path / name.replace(".", " (1).")).write_bytes(body)
        (tmp_path / name).write_bytes(b"older")
    entry = lambda name, rows: {"fileName": name, "sha256": hashlib.sha256(bodies[name]).hexdigest(), **rows}
    manifest = lambda *files: (tmp_path / "manifest.json").write_text(json.dumps({"fiscalYear": 8, "publicFiles": files}))
    tables = {"items.csv": CODES, "topics.json": T.StructType.fromDDL("id long")}
    manifest(entry("items.csv", {"rowCount": 2}), entry("topics.json", {"itemCount": 4}))
    found, rows = files.read_dataset(spark, str(tmp_path), tables)
    assert sorted(tuple(r) for r in found["items.csv"].collect()) == [("01", "a", 5), ("02", "b", None)] and found["topics.json"].count() == 3
    assert {r.name: (r.expected, r.actual, r.result) for r in rows.collect()} == {"items.csv": (2, 2, "PASS"), "topics.json": (4, 3, "FAIL")}
    with pytest.raises(files.Malformed, match="bytes"):
        files.read_dataset(spark, str(tmp_path), tables, most_bytes=10)
    for listed in ((entry("items.csv", {}),), (entry("items.csv", {}), entry("items.csv", {})), (entry("items.csv", {}) | {"sha256": "0" * 64}, entry("topics.json", {}))):
        manifest(*listed)
        with pytest.raises(files.Malformed):
            files.read_dataset(spark, str(tmp_path), tables)


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([("b", ' x "y"\nz ', ["p", 'q"']), ("a", "", [])], "k string, note string, tags array<string>")
    files.write_review(df, str(tmp_path / "r"), "k")
    assert one_file(tmp_path / "r").startswith('"k","note","tags"\n"a","","[]"\n')
    back = files.read_review(spark, str(tmp_path / "r"), df.columns, ("tags",))
    assert sorted(back.collect()) == sorted(df.collect())
    nulls = spark.createDataFrame([("b", None, None), ("a", "x,y", ["t"])], df.schema)
    files.write_seed(nulls, str(tmp_path / "s"), "k")
    assert sorted(files.read_seed(spark, str(tmp_path / "s"), ("tags",)).collect()) == sorted(nulls.collect())
    files.write_tsv(spark.createDataFrame([(" x ",)], "a string"), str(tmp_path / "t"))
    assert " x " in one_file(tmp_path / "t").splitlines()


def test_strict_json(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, day date, topics array<struct<slug:string,notes:struct<by:string,n:double,ok:boolean>>>, extra map<string,long>")
    good = {"id": 1, "day": "2026-01-02", "topics": [{"slug": "a", "notes": {"by": "x", "n": 1, "ok": True}}, {"slug": None, "notes": None}], "extra": {"k": 1}}
    folder = tmp_path / "j"
    folder.mkdir()
    for i in range(12):
        (folder / f"{i:02}.json").write_text(json.dumps([good, {**good, "id": i}] if i % 2 else {**good, "id": i}))
    assert files.read_json(spark, str(folder), schema).count() == 18
    for name, change, said in [
        ("deep", {"topics": [{"slug": "a", "notes": {"by": "x", "n": 1, "OBJECT<": 5}}]}, r"unknown key \$\.topics\[\]\.notes\.OBJECT< in deep\.json"),
        ("kind", {"topics": [{"slug": {"a": 1}}]}, r"\$\.topics\[\]\.slug isn't of type string everywhere in kind\.json"),
        ("text", {"id": "1"}, r"\$\.id isn't of type bigint everywhere in text\.json"),
        ("map", {"extra": {"k": "v"}}, r"\$\.extra\.k isn't of type bigint"),
    ]:
        bad = folder / f"{name}.json"
        bad.write_text(json.dumps({**good, **change}))
        with pytest.raises(files.Malformed, match=said):
            files.read_json(spark, str(folder), schema)
        bad.write_text("{}")
    (folder / "broken.json").write_text('{"id": 1')
    with pytest.raises(files.Malformed, match="broken.json isn't JSON"):
        files.read_json(spark, str(folder), schema)


def test_report(spark):
    wrong = spark.createDataFrame([("a|b", "x\ny", None)], "rule string, note string, n long")
    text = files.markdown("Checks", {"Errors": wrong, "Warnings": wrong.where("false")})
    assert text == "# Checks\n\n## Errors\n\n| rule | note | n |\n| - | - | - |\n| a\\|b | x y |  |\n\n## Warnings\n\nnone\n"
    with pytest.raises(ValueError):
        files.markdown("Checks", {"Errors": wrong}, most=0)


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_window_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "i long, k string").select((F.lit("2026-01-01").cast("timestamp") + F.make_interval(mins="i")).alias("ts"), "k")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = {(str(r.window_start)[11:16], r.k): (r.n, r.limited) for r in drained(windows.window_counts(stream, "k", limit=5), "complete", "counts")}
    assert got["00:00", "a"] == (6, True) and got["00:00", "b"] == (4, False) and len(got) == 6
    assert len(drained(windows.impressions(stream.withColumn("c", F.lit(1)), ["k", "c"]), "append", "seen")) == 2


def test_ndjson_and_fold(spark, tmp_path):
    lines = [("s1", 1, "started"), ("s1", 3, "complete"), ("s1", 2, "turn"), ("s2", 1, "started"), ("s2", 2, "error"), ("s2", 3, "complete")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.ndjson").write_text("\n".join(json.dumps(dict(zip(("slot", "seq", "kind"), x, strict=True))) for x in lines))
    stream = windows.ndjson(spark, str(tmp_path / "n"), "slot string, seq long, kind string")
    got = {r.slot: (r.status, r.turns) for r in drained(windows.folded_slots(stream), "update", "slots")}
    assert got == {"s1": ("done", 1), "s2": ("failed", 0)}


def test_fold_of_late_events(spark, tmp_path):
    """Batches in any order give the same state."""
    (tmp_path / "n").mkdir()
    batches = [[("a", 3, "complete"), ("b", 2, "turn")], [("a", 1, "started"), ("a", 2, "turn"), ("b", 3, "turn")], [("b", 1, "started"), ("c", 5, "error")], [("c", 1, "started")]]
    stream = windows.ndjson(spark, str(tmp_path / "n"), "slot string, seq long, kind string")
    q = windows.folded_slots(stream).writeStream.outputMode("update").format("memory").queryName("late").start()
    for i, lines in enumerate(batches):
        (tmp_path / "n" / f"{i}.ndjson").write_text("\n".join(json.dumps(dict(zip(("slot", "seq", "kind"), x, strict=True))) for x in lines))
        q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("late").collect():
        got.setdefault(r.slot, []).append((r.status, r.turns))
    assert got["a"] == [("planned", 0), ("done", 1)] and got["b"][-1] == ("running", 2) and got["c"] == [("failed", 0), ("failed", 0)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"posts": [{"id": "1", "text": "a"}, {"id": "2", "text": "b"}]}))
    (tmp_path / "2.json").write_text(json.dumps({"posts": [{"id": "2", "text": "b"}, {"id": "10", "text": "c"}]}))
    spark.dataSource.register(paged.PagedPosts)
    stream = spark.readStream.format("paged_posts").option("path", str(tmp_path)).load()
    assert sorted((r.id, r.text) for r in drained(stream, "append", "posts")) == [(1, "a"), (2, "b"), (10, "c")]
    (tmp_path / "10.json").write_text(json.dumps({"posts": [{"id": "10", "text": "c"}]}))
    with pytest.raises(Exception, match="does not get past id 10"):
        drained(stream, "append", "looped")
