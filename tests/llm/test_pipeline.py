import random

import corpus_pipeline
from quaestor.llm import catalog, op08_substring


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_stages(spark, documents, tmp_path):
    rng = random.Random(9)
    clean = [(i, text(rng, 200), f"s{i % 3}") for i in range(60)]
    passage = text(rng, 70)
    rows = clean + [(100, clean[3][1], "s0"), (101, clean[4][1].upper(), "s1"), (102, "short", "s1"), (103, "again and again " * 60, "s2"), (104, f"{text(rng, 60)} {passage}", "s0"), (105, f"{text(rng, 60)} {passage}", "s1"), (None, None, None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert ids["quality"] == {r[0] for r in rows} - {102, 103, None}
    assert ids["near_dedup"] == ids["quality"] - {100, 101}
    assert ids["substring_dedup"] == ids["near_dedup"]
    texts = {r.doc_id: r for r in kept["substring_dedup"]}
    assert all(texts[k].text == t for k, t, _ in clean) and len(texts[105].text) < len(rows[-2][1]) - op08_substring.SPAN
    assert texts[105].n_chars == len(texts[105].text)
    assert ids["mixing"] <= ids["near_dedup"] and kept["encoding"][0].n_tokens == len(kept["encoding"][0].ids)
    assert len(kept["encoding"]) == len(kept["mixing"])


def test_run_and_catalog(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [int(k[2:].split("_")[0]) for k in catalog.QUERIES] == list(range(1, 14))
