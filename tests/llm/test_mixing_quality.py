from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaestor.llm import op01_mixing, op05_quality


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing anew until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_totals(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, (i * 37) % 50 * (20 if i % 7 == 3 else 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = op01_mixing.mix(df).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want, taken = filled(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and (r["size"] or r.copies == 0)
        taken[r.source] += r.copies * r["size"]
    largest = max(n for _, _, n in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    again = {r.doc_id: r.copies for r in op01_mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_fractions_are_fair(spark):
    df = spark.createDataFrame([(i, "a" if i < 300 else "b", 1 + i % 3) for i in range(900)], "doc_id long, source string, size long")
    seen = defaultdict(int)
    for seed in range(12):
        for r in op01_mixing.mix(df, weights=(1.0, 5.0), seed=seed).where("source = 'a'").collect():
            seen[r["size"]] += r.copies
    rate = sum(n * k for k, n in seen.items()) / (12 * 600)
    assert all(abs(n / 1200 - rate) < 0.1 for n in seen.values())


@pytest.mark.parametrize(("key", "sources"), [(None, 2), (7, 3), (None, 4)])
def test_repeated_rows_stay_within_one_document(spark, key, sources):
    """Rows without an id, or of one id, all of a size, beside ordinary ones."""
    rows = [(key, "s0", 30, str(i % 5)) for i in range(1000)] + [(i, f"s{1 + i % (sources - 1)}", 20 + i % 40, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text string").repartition(6)
    got, sizes = op01_mixing.mix(df).collect(), Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    taken, want = Counter(), filled(sizes)
    for r in got:
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 3
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert abs(taken["s0"] - want["s0"]) <= 30
    again = Counter(tuple(r) for r in op01_mixing.mix(df.repartition(3)).collect())
    assert again == Counter(map(tuple, got))


def test_mix_odd_rows(spark, odd):
    sized = op01_mixing.word_sizes(odd).withColumn("copies", F.lit("clash"))
    got = op01_mixing.mix(sized).collect()
    assert len(got) == 9
    twins = [r.copies for r in got if r.doc_id == 1]
    assert len(twins) == 2 and max(twins) - min(twins) <= 1
    assert op01_mixing.mix(sized.limit(0)).count() == 0
    assert op01_mixing.mix(sized.where("doc_id = 2")).first().copies == 0


def quality(text):
    w = (text or "").split()  # the fixtures have ASCII blanks only
    lines = [x for x in (text or "").split("\n") if x.split()]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_metrics_by_brute_force(spark, odd):
    more = ["one two three\n" * 20, "a\n\na\n b\n b", "# * $ % & | < > é ü", " ".join(str(i % 9) for i in range(40)), "x " * 200]
    df = odd.unionByName(spark.createDataFrame([(100 + i, t, None, "u", 0) for i, t in enumerate(more)], odd.schema)).withColumn("n_words", F.lit("clash")).withColumn("_m", F.lit(0))
    for r in op05_quality.measured(df).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == quality(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_hosts(spark, documents):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "bad", "clean") for i in range(100)]
    rows += [(100 + i, "bad" if i % 20 else good, "junk") for i in range(100)]
    rows += [(300, "bad", "tiny"), (301, good, None), (302, "bad", None)] + [(400 + 40 * h + i, good, f"h{h}") for h in range(8) for i in range(40)]
    got = {r.doc_id: r for r in op05_quality.ruled(documents(rows)).collect()}
    assert not any(got[100 + i].kept for i in range(100))
    assert all(got[i].kept == (i % 10 > 0) for i in range(100)) and all(got[i].kept for i in range(400, 720))
    assert got[301].kept and not got[302].kept and got[301].host_rate is None
    assert 0 < got[300].host_rate < 1
    assert op05_quality.ruled(documents([])).count() == 0
    assert op05_quality.stage(spark, documents(rows), "").columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_beyond_the_base(spark, documents):
    good = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    symbols = lambda k: " ".join(f"word{k}x{i}" + "$" * (i % 4 == 0) for i in range(40))
    few = lambda k: " ".join(f"word{k}x{i}" + "$" * (i % 7 == 0) for i in range(42))
    lines = "\n".join(["the same line"] * 5 + [f"line {i} has words{i} unlike{i} others{i}" for i in range(8)])
    one_of_three = f"the same line\n{good(1)}\nthe same line"
    rows = [(i, symbols(i) if i < 2 else few(i) if i < 4 else good(i), "clean") for i in range(100)]
    rows += [(100 + i, symbols(i) if i < 40 else good(i), "mixed") for i in range(100)]
    rows += [(200 + i, symbols(i) if i < 80 else good(i), "junk") for i in range(100)]
    rows += [(300, lines, None), (301, one_of_three, None), (302, " ".join("abcdefghijklmnopqrstuvwxyz"), None), (303, " ".join(f"{i:012d}" for i in range(30)), None), (304, symbols(7), None), (305, few(7), None), (306, good(5), None)]
    got = {r.doc_id: r for r in op05_quality.weighed(documents(rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [k for k in range(300, 307) if got[k].kept] == [301, 306]
    assert not any(got[200 + i].kept for i in range(100))  # by their host's failures of these rules
    assert not any(got[100 + i].kept for i in range(40)) and all(got[100 + i].kept for i in range(40, 100))
    assert got[2].kept and got[3].kept and not got[0].kept  # a clean host's bounds are wider
    stage = {r.doc_id for r in op05_quality.stage(spark, documents(rows), "").collect()}
    assert stage == {k for k, r in got.items() if r.kept}
    assert op05_quality.weighed(documents([])).count() == 0


def test_symbols_in_the_table(spark):
    """All labelled bad documents of symbols go, no labelled good one does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = op05_quality.weighed(docs).join(labels, "doc_id").where(~F.col("base_failed"))
    assert got.where("quality = 0 and n_symbols > 0.1 * n_words and kept").count() == 0
    assert got.where("quality = 1 and not kept").count() == 0
