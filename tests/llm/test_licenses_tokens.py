import base64
import time

import duckdb
import pytest
import tiktoken

from quaestor.llm import op04_licenses as L
from quaestor.llm import op09_tokens as K


def found(df):
    return {(r.doc_id, r.license): r for r in df.collect()}


def test_planted_notices(spark, documents, odd):
    mit, gpl = L.TEMPLATES["mit"], L.TEMPLATES["gpl-3.0"]
    gpl_words = gpl.split()
    near = " ".join(w if i != len(gpl_words) // 2 else "changed" for i, w in enumerate(gpl_words))
    half = " ".join(gpl_words[: len(gpl_words) // 2])
    filler = " ".join(f"filler{i}" for i in range(500))
    docs = documents([(10, f"{filler} {mit} {filler}", None), (11, near.upper(), "s"), (12, half, "s"), (13, L.TEMPLATES["cc-by-nc-4.0-line"], "s"), (14, "Licensed under CC", "s")])
    got = found(L.scanned(docs.unionByName(odd)))
    assert set(got) == {(10, "mit"), (10, "mit-grant"), (11, "gpl-3.0"), (11, "gpl-2.0"), (13, "cc-by-nc-4.0-line")}
    assert got[11, "gpl-2.0"].containment < got[11, "gpl-3.0"].containment
    assert got[10, "mit"].containment == 1.0 and 0.8 <= got[11, "gpl-3.0"].containment < 1
    assert L.scanned(documents([])).count() == 0 and L.scanned(docs, templates={}).count() == 0


def test_repeated_rows_count_each(spark, documents, tmp_path):
    text = f"words before {L.TEMPLATES['mit']} and after"
    documents([(1, text, "s"), (1, text, "s"), (1, f"more {text}", "s"), (2, text, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = L.op4_license_scan(spark, str(tmp_path)).collect()
    want = con.execute(L.SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.n_windows for r in got}) > 1


def test_every_template_is_found(spark, documents):
    docs = documents([(i, f"some words before {t} and after", "s") for i, t in enumerate(L.TEMPLATES.values())])
    got = found(L.scanned(docs))
    assert all(got[i, k].containment == 1.0 for i, k in enumerate(L.TEMPLATES))
    table = spark.createDataFrame([("own", "every word of this notice has to be there"), (None, "x"), ("none", None)], "license string, text string")
    assert set(found(L.scanned(documents([(1, "a b EVERY word of this notice has to be there c", "s")]), table))) == {(1, "own")}


def test_long_text_of_notices(spark, documents):
    """50,000 words of notices: the work grows with the length."""
    line = L.TEMPLATES["mit-line"]
    docs = documents([(1, " ".join([line] * 10000), "s"), (2, " ".join(list(L.TEMPLATES.values()) * 15), "s")])
    began = time.time()
    got = found(L.scanned(docs))
    assert time.time() - began < 45
    assert (1, "mit-line") in got and {k for i, k in got if i == 2} == set(L.TEMPLATES)


def test_sql(spark, tmp_path, documents):
    words = "released under the mit license version of and to a".split()
    texts = [" ".join(words[(i * j) % (7 + j % 3)] for j in range(i % 40)) for i in range(150)] + [v for v in L.TEMPLATES.values()]
    docs = documents([(i, t, "s") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(L.SQL).fetchall())
    got = L.op4_license_scan(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in ("doc_id", "license", "containment", "n_windows", "first_word")) for r in got.collect()) == want and want


def test_lengths_and_limits(spark, odd, documents):
    with open(K.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("test", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = documents([(20 + i, "word " * (i * i % 17), None) for i in range(60)])
    docs = odd.unionByName(extra)
    lengths = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    sums = K.suffix_sums(K.histogram(K.counted(docs.withColumn("_text", docs.lang).withColumn("n_tokens", docs.lang))))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert (r.docs, r.docs_within) == (lengths.count(n), sum(x <= n for x in lengths))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.tokens_within == sum(x for x in lengths if x <= n)
        assert r.quantile == pytest.approx(r.docs_within / len(lengths))
    limits = [1, 2, 5, 9, 100, 10**6]
    got = {r.context_limit: (r.docs_within, r.truncated_tokens) for r in K.at_limits(sums, limits).collect()}
    assert got == {n: (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths)) for n in limits}
    ordered = sorted(lengths)
    assert K.at_quantiles(sums, [0.5]).first().n_tokens == ordered[-(-len(ordered) // 2) - 1]
    assert K.suffix_sums(K.histogram(K.counted(documents([])))).count() == 0
