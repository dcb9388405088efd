import hashlib

import pytest
from pyspark.sql import functions as F

from quaestor.sources import artifacts


def frame(spark, rows):
    made = [(y, k, n, hashlib.sha256(c).hexdigest() if d is None else d, c) for y, k, n, c, d in rows]
    return spark.createDataFrame(made, artifacts.SCHEMA).repartition(4, "name")


def write(df, root):
    df.sparkSession.dataSource.register(artifacts.Artifacts)
    df.write.format("artifacts").mode("append").option("path", str(root)).save()


def objects(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_written_once_and_read_back(spark, tmp_path):
    rows = [(2026, "csv", f"{i}.csv", b"x" * i, None) for i in range(9)]
    write(frame(spark, rows), tmp_path)
    first = objects(tmp_path)
    assert first == sorted(f"2026/csv/{hashlib.sha256(c).hexdigest()}/{n}" for _, _, n, c, _ in rows)
    at = {p: (tmp_path / p).stat().st_mtime_ns for p in first}
    write(frame(spark, rows[:4] + rows[:2] + [(2026, "pdf", "new", b"n", None)]), tmp_path)
    assert len(objects(tmp_path)) == 10 and all((tmp_path / p).stat().st_mtime_ns == t for p, t in at.items())
    back = spark.read.format("artifacts").option("path", str(tmp_path)).load()
    assert back.where(F.sha2("content", 256) == F.col("sha256")).count() == 10
    (tmp_path / first[3]).write_bytes(b"other")
    with pytest.raises(Exception, match="content of its digest"):
        back.collect()


def test_a_failing_task_leaves_nothing_new(spark, tmp_path):
    write(frame(spark, [(2026, "csv", "old", b"old", None)]), tmp_path)
    old = objects(tmp_path)
    for bad in [(2027, "csv", "bad", b"b", "0" * 64), (2027, "csv", "../bad", b"b", None), (2027, "csv", "none", b"n", None)]:
        rows = frame(spark, [(2027, "csv", f"{i}", b"%d" % i, None) for i in range(8)] + [(2026, "csv", "old", b"old", None), bad])
        with pytest.raises(Exception, match="has changed|isn't a path|needs a year"):
            write(rows.withColumn("kind", F.when(F.col("name") != "none", F.col("kind"))), tmp_path)
        assert objects(tmp_path) == old and not list(tmp_path.glob(".staged*"))


def test_a_failing_commit_undoes_its_own_alone(spark, tmp_path):
    write(frame(spark, [(2026, "csv", "old", b"old", None), (2026, "csv", "spoilt", b"s", None)]), tmp_path)
    old = objects(tmp_path)
    spoilt = next(p for p in old if p.endswith("spoilt"))
    (tmp_path / spoilt).write_bytes(b"changed")
    with pytest.raises(Exception, match="other content"):
        write(frame(spark, [(2026, "csv", f"{i}", b"%d" % i, None) for i in range(8)] + [(2026, "csv", "old", b"old", None), (2026, "csv", "spoilt", b"s", None)]), tmp_path)
    assert objects(tmp_path) == old and not list(tmp_path.glob(".staged*")) and not (tmp_path / "2027").exists()


def test_empty_and_overwrite(spark, tmp_path):
    write(frame(spark, [(2026, "csv", "a", b"a", None)]).where("false"), tmp_path)
    assert objects(tmp_path) == []
    with pytest.raises(Exception, match="only added"):
        frame(spark, [(2026, "csv", "a", b"a", None)]).write.format("artifacts").mode("overwrite").option("path", str(tmp_path)).save()
