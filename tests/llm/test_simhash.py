import random

import numpy as np
import pytest
import xxhash

from quaestor.llm import op02_simhash
from quaestor.llm.common import components


def brute(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_fingerprints(spark, odd):
    extra = spark.createDataFrame([(50, "É Ab\x0bcD", None, None, 0), (51, "a " * 700 + "ÄÖ", None, None, 0), (52, "word" * 30 + " b c d", None, None, 0)], odd.schema)
    docs = odd.unionByName(extra)
    want = sorted((str(r.doc_id), brute(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in op02_simhash.fingerprinted(docs).collect()) == want


@pytest.mark.parametrize("dense", [1024, 3])
def test_links_by_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(op02_simhash, "DENSE", dense)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = components(op02_simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r.node: r.root for r in got}
    want, ours = classes(prints), {}
    for (s,), p in zip(signed, prints, strict=True):
        ours.setdefault(root.get(s, s), set()).add(p)
    expected = {}
    for p, c in want.items():
        expected.setdefault(c, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(41)) and all(got.get(100 + i, 100) == 100 for i in range(30))


def test_documents(spark, odd, documents):
    got = {(r.doc_id, r.fp): r.component_id for r in op02_simhash.near_duplicates(odd).collect()}
    assert op02_simhash.near_duplicates(odd).count() == 9
    assert got[(1, op02_simhash.near_duplicates(odd).where("doc_id = 1").first().fp)] == 1
    assert {c for (k, p), c in got.items() if p == 0} == {2}  # texts without words
    assert op02_simhash.near_duplicates(documents([])).count() == 0
    assert op02_simhash.near_duplicates(documents([(None, "a b", None)])).first().component_id is None
    text = " ".join(f"w{i}" for i in range(300))
    docs = documents([(9, text, "a"), (3, text, "b"), (4, text + " end", "b"), (5, "other words here", None), (None, "null id", None), (None, "second null id text", None)])
    kept = op02_simhash.stage(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "5", "None", "None"] and kept[0].asDict().keys() == set(docs.columns)


def test_stage_links_similar_texts(spark):
    """Of any two documents left, none have 5-word Jaccard similarity of 0.8 or more; clean ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def grams(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    def pairs(rows):
        sets = [(r.doc_id, grams(r.text)) for r in rows]
        for i, (j, x) in enumerate(sets):
            for k, y in sets[:i]:
                n = len(x & y)
                if n and 5 * n >= 4 * len(x | y):
                    yield j, k

    rows = docs.collect()
    kept = op02_simhash.stage(spark, docs, "").collect()
    alike = {k for p in pairs(rows) for k in p}
    near = {r.doc_id: r.component_id for r in op02_simhash.near_duplicates(docs).collect()}
    assert any(near[j] != near[k] for j, k in pairs(rows))  # 3 bits don't reach them
    assert not list(pairs(kept))
    sizes = {c: sum(x == c for x in near.values()) for c in near.values()}
    lone = {k for k, c in near.items() if sizes[c] == 1} - alike
    assert lone <= {r.doc_id for r in kept}


def test_similar_texts_of_a_large_bucket(spark, documents):
    """Texts that resemble each other but not the one that all are compared with first."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    # Each text drifts from the one before it: neighbours have 0.89, the first and the sixth less than 0.8.
    rows = [(i, " ".join(words[17 * i : 17 * i + 300]), "s") for i in range(30)]
    kept = op02_simhash.stage(spark, documents(rows), "").collect()
    assert [r.doc_id for r in kept] == [0]


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 20, 150, 3000):
        for shared in (0.0, 0.5, 0.8, 0.95, 1.0):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: int(n * shared)], rng.integers(0, 1 << 63, n - int(n * shared), dtype=np.uint64)])
            bits = sum(int(a).bit_count() for a in (op02_simhash.parities(x) ^ op02_simhash.parities(y)).view(np.uint64))
            apart, common = len(np.setxor1d(x, y)), len(np.intersect1d(x, y))
            assert bits <= apart and bits % 2 == apart % 2
            if 5 * common >= 4 * (2 * n - common):  # similar enough, so the bound lets them through
                assert 9 * bits <= 2 * n


def test_stage_takes_copies_of_similar_texts(spark, documents):
    """Similar texts, each with many copies: under ids of their own, under one id, and without any."""
    words = [f"w{i}" for i in range(330)]
    a, b, c = (" ".join(words[k : k + 300]) for k in (0, 14, 28))
    rows = [(i, a, "s") for i in range(20, 60)] + [(7, b, "s")] * 20 + [(None, c, "s")] * 20
    kept = op02_simhash.stage(spark, documents(rows), "").collect()
    assert [(r.doc_id, r.text) for r in kept] == [(7, b)]
    nameless = op02_simhash.stage(spark, documents([(None, a, "s")] * 20 + [(None, b, "s")] * 20), "").collect()
    assert len(nameless) == 1 and nameless[0].doc_id is None
