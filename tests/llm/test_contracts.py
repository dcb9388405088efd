"""Every registered query over one small table, against plain Python; and columns of clashing names through the stages."""

import hashlib
import random
import zlib

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from quaestor.llm import catalog, op05_quality, op07_sharding

CLASHES = ("_id", "_h", "_doc", "_text", "_gone", "_row", "_src", "_key", "n_words", "kept", "host_rate", "base_failed", "target", "copies", "source_size", "size", "doc", "h", "row", "ids", "gone", "fp", "id", "th")


def rows():
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    made = [(i, text(rng.randint(25, 120)), f"s{i % 3}") for i in range(40)]
    return [*made, (50, made[3][1], "s0"), (51, None, "s1"), (52, "", None), (None, text(30), "s2"), (53, "é€ " * 12, "s1"), (53, "é€ " * 12, "s1"), (54, "x y\n \n \n\u0085\n ", "s0")]


def test_queries(spark, documents, tmp_path):
    docs = documents(rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows()[3][1]), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {k: q(spark, str(tmp_path)).collect() for k, q in catalog.QUERIES.items()}
    by = lambda name: {r.doc_id: r for r in got[name]}
    texts = {k: t for k, t, _ in rows()}
    words = lambda t: (t or "").encode().split()
    for name in ("op1_mixing", "op2_simhash", "op3_media", "op5_quality", "op6_sentencepiece", "op7_sharding", "op10_lm_scoring", "op11_toxicity", "op12_periodic_runs"):
        assert len(got[name]) == len(rows()), name
    best = sorted((r["rank"], r.doc_id) for r in got["op13_ranked_search"])
    assert len(best) == 10 and best[:2] == [(1, 3), (2, 50)] and {r.item_id for r in got["op13_ranked_search"]} == {0}
    sizes = {}
    for k, t, s in rows():
        sizes[s] = sizes.get(s, 0) + len(words(t))
    for r in got["op1_mixing"]:
        assert r["size"] == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
    for k, r in by("op2_simhash").items():
        w = words((texts[k] or "").lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    assert by("op2_simhash")[50].component_id == 3 and by("op2_simhash")[52].component_id == 51
    for k, r in by("op3_media").items():
        data = (texts[k] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.feature) == 16 and r.media_bytes > 0 and len(r.media_sha256) == 64
    assert by("op5_quality")[54].n_dup_lines == 2  # U+2028 is a word, here on three lines that are equal
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got["op6_sentencepiece"])
    for r in got["op7_sharding"]:
        assert r.text_sha256 == (None if texts[r.doc_id] is None else hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert [(r.doc_id, r.first_docs) for r in got["op8_substring_dedup"]] == [(50, [3])]
    assert sum(r.docs for r in got["op9_token_counts"]) == len(rows()) and got["op4_license_scan"] == []
    for r in got["op10_lm_scoring"]:
        assert r.n_tokens == len(words(texts[r.doc_id])) + 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_clashing_columns(spark, documents, tmp_path):
    docs = documents(rows())
    clashing = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns, name
        left = out.collect()
        assert left and all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in left for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, str(tmp_path)).count() == len(rows())


def test_lines_of_unicode_separators(spark, documents):
    r = op05_quality.measured(documents([(1, " \n \n ", "s"), (2, "\u0085\n\u0085\n \n ", "s")])).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_dup_lines, x.n_lines) for x in r] == [(3, 2, 3), (2, 1, 2)]


def test_tiers_by_brute_force(spark, documents, tmp_path):
    """Compaction merges just the tiers that are full, and leaves the others' shards as they are."""
    root = f"{tmp_path}/store"
    rng = random.Random(3)
    for n in (400, 400, 3, 3, 3, 3, 60):
        op07_sharding.append(spark, root, documents([(i, " ".join(str(rng.random()) for _ in range(20)), "s") for i in range(n)]).coalesce(1))
    shards = lambda: {r.shard: r for r in op07_sharding.manifest(spark, root).where("shard is not null").collect()}
    before = shards()
    target = max(r.bytes for r in before.values())

    def tier(size):
        t, least = 0, target / 4
        while size < least:
            t, least = t + 1, least / 4
        return t

    while True:
        now, tiers = shards(), {}
        for k, r in now.items():
            tiers.setdefault(tier(r.bytes), set()).add(k)
        full = {t for t, s in tiers.items() if t and len(s) >= 4}
        if now.keys() != before.keys() or not full:
            break
        op07_sharding.compact(spark, root, target=target)
        gone = set().union(*(tiers[t] for t in full))
        assert shards().keys() & now.keys() == now.keys() - gone
    assert sum(r.rows for r in shards().values()) == 872 and len(shards()) < len(before)
