import json

from pyspark.sql import functions as F

from quaestor.operators import nesting as N


def test_lists_from_one_pass(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 1, None), (None, 1, "x")], "k string, n int, t string")
    made = N.lists_of(rows, "k", {"xs": (F.col("t") == "x", [F.col("n")], F.col("n")), "every": (F.lit(True), [F.col("n"), F.col("t")], F.struct("n", "t"))})
    got = {r.k: ([*r.xs], [tuple(x) for x in r.every]) for r in N.with_lists(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), "k", made).collect()}
    assert got == {"a": ([2], [(1, "y"), (1, "y"), (2, "x")]), "b": ([], [(1, None)]), "c": ([], []), None: ([], [])}
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_references_once(spark):
    row = spark.sql("select array(named_struct('f', 'b'), named_struct('f', 'a')) as x, array(named_struct('f', 'a')) as y").select(N.references(F.col("x"), F.col("y")).alias("r")).first()
    assert [r.f for r in row.r] == ["a", "b"]


def test_tree_and_nodes_agree(spark):
    leaves = [(a, b, c, f"{a}{i % 2}", i) for i, (a, b, c) in enumerate((a, b, c) for a in "xy" for b in "12" for c in "pqr" for _ in range(3))]
    df = spark.createDataFrame(leaves, "a string, b string, c string, an string, v long").withColumns({"bn": F.col("b"), "cn": F.col("c"), "leaf": F.struct("v")})
    levels = [("a", "an", "bs"), ("b", "bn", "cs"), ("c", "cn", "leaves")]
    docs = {r.code: json.loads(r.j) for r in N.tree(df, levels, "v", "leaf").withColumn("j", F.to_json(F.struct("*"))).collect()}
    flat = {tuple(r.path): (r.name, r.amount, r.leaves) for r in N.nodes(df, [(c, n) for c, n, _ in levels], "v").collect()}
    assert len(flat) == 2 + 4 + 12
    for a in "xy":
        own = [r for r in leaves if r[0] == a]
        assert docs[a]["amount"] == flat[(a,)][1] == sum(r[4] for r in own) and docs[a]["name"] == flat[(a,)][0] == f"{a}0"
        assert [b["code"] for b in docs[a]["bs"]] == ["1", "2"]
        for b in docs[a]["bs"]:
            for c in b["cs"]:
                assert [x["v"] for x in c["leaves"]] == [r[4] for r in own if r[1:3] == (b["code"], c["code"])]
                assert flat[(a, b["code"], c["code"])][1:] == (c["amount"], 3)
    empty = df.where("false")
    assert N.tree(empty, levels, "v", "leaf").count() == N.nodes(empty, [(c, n) for c, n, _ in levels], "v").count() == 0
