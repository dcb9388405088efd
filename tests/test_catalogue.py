from pyspark.sql import functions as F

from quaestor.operators import catalogue as K


def rules():
    return [
        K.rows_of("ROWS", "programs", 6), K.Value("SUM", "programs", F.sum("amount"), 100), K.never("NEGATIVE", "programs", F.col("amount") < 0),
        *K.totals("TOTAL", "programs", "account", F.col("amount"), {"a": 30, "b": 5}), K.rows_of("ITEMS", "items", 3),
        K.Reference("ITEM", "programs", "item", "items", "key"), K.Reference("ITEM_OR_NONE", "programs", "item", "items", "key", optional=True),
        K.Unique("ID", "programs", ("id",)), K.Unique("ID_ITEM", "programs", ("id", "item")), K.Unique("KEY", "items", ("key",)),
    ]


WANT = {
    "ROWS": (6, "PASS", None), "SUM": (34, "FAIL", None), "NEGATIVE": (1, "FAIL", None), "TOTAL:a": (30, "PASS", None), "TOTAL:b": (-1, "FAIL", None), "TOTAL:other": (2, "FAIL", None), "ITEMS": (3, "PASS", None),
    "ITEM": (3, "FAIL", "z"), "ITEM_OR_NONE": (2, "FAIL", "z"), "ID": (2, "FAIL", "1"), "ID_ITEM": (1, "FAIL", "2/z"), "KEY": (0, "PASS", None),
}


def tables(spark, seen=None):
    rows = [(1, "a", "x", 10), (1, "a", "y", 20), (2, "b", "z", -1), (2, "c", "z", 5), (3, None, None, None), (None, "b", "x", None)]
    programs = spark.createDataFrame(rows, "id long, account string, item string, amount long")
    if seen is not None:

        def counted(parts):
            for pdf in parts:
                seen.add(len(pdf))
                yield pdf

        programs = programs.mapInPandas(counted, programs.schema)
    return {"programs": programs, "items": spark.createDataFrame([("x",), ("y",), ("w",)], "key string")}


def by_code(df):
    return {r.code: (r.actual, r.result, r.first) for r in df.collect()}


def test_checked(spark):
    assert by_code(K.checked(tables(spark), rules())) == WANT


def test_written_computes_each_table_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    assert by_code(K.written(tables(spark, seen), rules(), str(tmp_path / "d"))) == WANT
    assert seen.value == 6 and spark.read.parquet(str(tmp_path / "d" / "programs")).count() == 6


def test_values_of_a_table_take_one_scan(spark, tmp_path):
    held = {}
    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / name))
        held[name] = spark.read.parquet(str(tmp_path / name))
    plan = K.checked(held, [r for r in rules() if isinstance(r, K.Value)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_empty(spark):
    empty = {k: df.where("false") for k, df in tables(spark).items()}
    got = by_code(K.checked(empty, rules()))
    assert got["ROWS"] == (0, "FAIL", None) and got["SUM"] == (None, "FAIL", None) and got["TOTAL:a"] == (0, "FAIL", None) and got["ITEM"] == (0, "PASS", None) and got["KEY"] == (0, "PASS", None)
