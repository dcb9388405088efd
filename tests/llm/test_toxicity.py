"""Toxicity: the grammar's rules, what it learns, and held-out documents."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quaestor.llm import op11_toxicity as op


def total(text, entries=(("scum ", 4.0), ("gru", 3.0))):
    return sum(x[0] for x in op.clause_scores(text, op.matcher(list(entries)), op.grammar()))


def test_grammar():
    plain = total("what scum this is.")
    assert plain == 4.0 and total("no match here.") == 0.0
    assert total("you are scum.") == total("scum, you.") == 4.0 + op.AIMED
    assert total("you and all of these many others. scum.") == 4.0  # a target reaches within its clause alone
    assert total("this is not scum.") == pytest.approx(4.0 * op.NEGATED)
    assert total("not to be told again of such scum.") == 4.0  # out of the negation's reach
    assert total("the paper said that scum floats.") == pytest.approx(4.0 * op.REPORTED)
    assert total("he wrote a book. scum.") == 4.0
    assert total("i will kill you.") == op.THREAT and total("the frost will kill the roses.") == 0.0
    assert total("they said they will hurt you.") == pytest.approx(op.THREAT * op.REPORTED)
    assert total("gruwort und grumel") == 6.0 and total("angru scums") == 0.0  # beginnings of words; whole words
    assert [x[0] for x in op.clause_scores("scum. fine\nscum scum", op.matcher([("scum ", 4.0)]), op.grammar())] == [4.0, 8.0]


def test_composition_is_a_table():
    after, factor, added = op.grammar()
    assert after.shape == factor.shape == added.shape and after.max() < len(after)
    state = 0
    for x in ("report", "negation", "insult"):
        k = op.SYMBOLS.index(x)
        last, state = factor[state, k], after[state, k]
    assert last == pytest.approx(op.NEGATED * op.REPORTED)


def corpus(n=900, copies=40):
    rng = random.Random(4)
    syllables = ["ba", "do", "ki", "le", "mu", "na", "po", "ri", "su", "ta"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grobian", "zorx" + word(), "VEXQUE" + word()]))
        docs.append((i, " ".join(words) + "."))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    # Many copies of one toxic text don't make its other words suspect.
    text = docs[8][1]
    docs += [(n + i, text) for i in range(copies)]
    labels += [(n + i, 1, 1) for i in range(copies)]
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in op.scored(d.withColumn("score", F.lit("mine")), t).collect()}
    assert len(out) == len(docs)
    held = [r for r in out.values() if r.held_out and r.doc_id < 900]
    assert len(held) > 120 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.98 * len(held)
    clean = [r for r in out.values() if r.doc_id < 900 and r.doc_id % 8]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    learnt = {w for w, _ in op.lexicon(d.join(t, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic")))} - {f"{w} " for w in op.INSULTS}
    assert {"zorx", "vexque"} <= learnt and any("grobian".startswith(w.strip()) for w in learnt) and len(learnt) <= 6


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(300, 0)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a, b = ([tuple(r) for r in op.scored(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op.scored(odd, none).collect()
    assert len(got) == 9 and all(r.predicted == 0 and r.clause_score == 0 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, None), (None, 1, 1), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(op.scored(odd, labels).collect()) == 9
    assert op.scored(odd.limit(0), labels).collect() == []
    long = spark.createDataFrame([(1, "word " * 60000 + "you idiot " + "word " * 60000)], "doc_id long, text string")
    (r,) = op.scored(long, none).collect()
    assert r.n_clauses == 1 and r.clause_score == op.LEAST + op.AIMED
