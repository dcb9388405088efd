import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import op07_sharding as G
from quaestor.llm import op08_substring as D


def table(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_store(spark, tmp_path, odd, documents):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    assert G.compact(spark, root) == 0 and G.vacuum(spark, root) == 0
    docs = odd.withColumn("since", F.lit("clash"))
    late = documents([(7, "late", "s")]).withColumn("since", F.lit("clash"))
    kept = [c for c in docs.columns if c != "since"]
    assert G.append(spark, root, docs.repartition(3), rows=2) == 1
    first = G.manifest(spark, root).where("shard is not null").count()
    assert first >= 4
    version = G.compact(spark, root, target=1 << 30)
    after = G.manifest(spark, root).where("shard is not null")
    assert version > 1 and after.count() < first and after.agg(F.sum("rows")).first()[0] == 9
    assert table(G.snapshot(spark, root).select(*kept)) == table(docs.select(*kept))
    assert table(G.snapshot(spark, root, 1).select(*kept)) == table(docs.select(*kept))  # old versions stay readable
    G.append(spark, root, late)
    assert G.vacuum(spark, root) > 0 and len(G.versions(spark, root)) == 1
    assert table(G.snapshot(spark, root).select(*kept)) == table(docs.unionByName(late).select(*kept))
    with pytest.raises(ValueError):
        G.append(spark, root, docs.drop("lang"))


@pytest.mark.parametrize("target", [1 << 20, 4 << 20])
def test_merged_files_come_near_the_target(spark, tmp_path, target):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    with pytest.raises(ValueError):
        G.snapshot(spark, root)
    noise = np.random.default_rng(1)
    for _ in range(6):
        rows = [(i, noise.bytes(900).hex()) for i in range(target // 7000)]
        G.append(spark, root, spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    G.compact(spark, root, target=target)
    shards = G.manifest(spark, root).where("shard is not null").collect()
    merged = [r.bytes for r in shards if r.bytes >= target / 4]
    assert merged and all(target / 2 <= b <= 1.5 * target for b in merged)
    assert sum(r.rows for r in shards) == G.snapshot(spark, root).count() == 6 * (target // 7000)


def test_two_writers(spark, tmp_path, documents):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    G.append(spark, root, documents([(1, "a", "s")]))
    with pytest.raises(G.Conflict):
        G._commit(spark, root, G.manifest(spark, root), 1)
    assert G.versions(spark, root) == [1]


def test_empty_store(spark, tmp_path, documents):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    G.append(spark, root, documents([]))
    assert G.snapshot(spark, root).count() == 0 and "shard" in G.snapshot(spark, root).columns


def cut_by_brute_force(data):
    gear, out = D._gear(), [0]
    for i in range(1, len(data)):
        if data[i - 1 : i].isspace() and not data[i : i + 1].isspace():
            h = 0
            for k in range(min(D.WINDOW, i)):
                h = (h + (int(gear[data[i - 1 - k]]) << k)) % 2**32
            if h < 2**32 // D.WORDS:
                out.append(i)
    return [*out, len(data)]


def test_cuts():
    rng = random.Random(4)
    data = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(3000)).encode()
    assert D.cuts(np.frombuffer(data, np.uint8)).tolist() == cut_by_brute_force(data)
    moved = D.cuts(np.frombuffer(b"inserted words " + data, np.uint8)) - 15
    assert set(D.cuts(np.frombuffer(data, np.uint8)).tolist()[3:]) <= set(moved.tolist())
    wall = ("é" * 2000).encode()
    edges = D.cuts(np.frombuffer(wall, np.uint8)).tolist()
    assert max(np.diff(edges)) <= D.LONGEST and all(wall[a:b].decode() for a, b in zip(edges, edges[1:], strict=False))


def test_planted_passages(spark, documents, odd):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean, passage = [text(300) for _ in range(40)], text(60)
    rows = [(i, t, "s") for i, t in enumerate(clean)]
    rows += [(100 + i, f"{text(80)} {passage} {text(90)}", None) for i in range(30)] + [(200, clean[5], "s"), (None, clean[6], "s")]
    found = D.spans(documents(rows)).collect()
    by = {r.doc: r for r in found}
    assert {r.doc for r in found} == {*range(101, 130), 200, None}
    assert 5 in by[200].first_docs and by[200].start == 0 and by[200].end == len(clean[5])
    texts = {k: t for k, t, _ in rows}
    for r in found:
        if r.doc and 100 < r.doc < 200:
            assert texts[r.doc].encode()[r.start : r.end].decode().strip() in passage and 100 in r.first_docs
    left = {r.doc_id: r.text for r in D.deduplicated(documents(rows).withColumn("_gone", F.lit(1))).collect()}
    assert left[100] == texts[100] and all(left[i] == clean[i] for i in range(40)) and left[200] == "" and left[None] == ""
    assert all(len(left[i]) < len(texts[i]) - 100 for i in range(101, 130))
    assert D.deduplicated(odd).count() == 9 and D.spans(documents([])).count() == 0
    assert {r.doc for r in D.spans(odd).collect()} == set()


def test_cuts_without_blanks():
    rng = random.Random(7)
    kinds = {
        "chinese": lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)),
        "code": lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz(){};=.,0123456789") for _ in range(n)),
        "spaced": lambda n: "".join(rng.choice("abcdefghij\u00a0\u3000") for _ in range(n)),
        "emoji": lambda n: "".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(n)),
    }
    for make in kinds.values():
        data = make(150000)  # some of it lies across blocks
        edges = D.cuts(np.frombuffer(data.encode(), np.uint8)).tolist()
        whole = data.encode()
        assert all(whole[a:b].decode() for a, b in zip(edges, edges[1:], strict=False))
        assert 30 < np.mean(np.diff(edges)) < 90 and max(np.diff(edges)) <= D.LONGEST + 3
        for more in ("x", make(1), make(333)):
            moved = D.cuts(np.frombuffer((more + data).encode(), np.uint8)) - len(more.encode())
            late = [e for e in edges if e > 1500]
            assert len(set(late) - set(moved.tolist())) <= len(late) // 500


def test_moved_passage_without_blanks(spark, documents):
    rng = random.Random(8)
    text = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    passage, clean = text(500), [text(900) for _ in range(5)]
    rows = [(i, t, "s") for i, t in enumerate(clean)]
    rows += [(10 + i, text(200 + i) + passage + text(100 + 7 * i), "s") for i in range(6)]
    found = {r.doc: r for r in D.spans(documents(rows)).collect()}
    assert set(found) == set(range(11, 16))
    texts = {k: t for k, t, _ in rows}
    for k, r in found.items():
        cut = texts[k].encode()[r.start : r.end].decode()
        assert cut in passage and len(cut) > 350 and r.first_docs == [10]


def spans_by_brute_force(rows, shortest=D.SPAN):
    """{(id, text): [(start, end)]} from the chunks of every text, one at a time."""
    spark_hash = {}
    for k, t, h in rows:
        spark_hash[k, t] = h
    turn = lambda k, t: k if k is not None else (spark_hash[k, t] % 2**64 >> 2) | D.NAMELESS
    made, home = {}, {}
    for k, t in spark_hash:
        data = (t or "").encode()
        edges = D.cuts(np.frombuffer(data, np.uint8)).tolist() if data else [0]
        made[k, t] = [(a, b, data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        for _, _, c in made[k, t]:
            home[c] = min(home.get(c, 2**63), turn(k, t))
    out = {}
    for (k, t), cs in made.items():
        runs, n = [[]], len((t or "").encode())
        for a, b, c in cs:
            if home[c] < turn(k, t):
                runs[-1].append((a, b, home[c]))
            elif runs[-1]:
                runs.append([])
        for run in runs:
            firm = [i for i, (a, b, h) in enumerate(run) if b - a >= D.FIRM or a == 0 or b == n or (i and run[i - 1][2] == h) or (i + 1 < len(run) and run[i + 1][2] == h)]
            if firm and run[firm[-1]][1] - run[firm[0]][0] >= shortest:
                out.setdefault((k, t), []).append((run[firm[0]][0], run[firm[-1]][1]))
    return out


def test_spans_by_brute_force(spark, documents):
    """Shared ids, null ids, several scripts: each text is cut by its own spans alone."""
    rng = random.Random(12)
    kinds = [lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))), lambda: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.randint(1, 12))), lambda: rng.choice("éüñø") * rng.randint(1, 3) + rng.choice("xyz")]
    text = lambda n, k: " ".join(kinds[k]() for _ in range(n))
    passages = [text(40, k % 3) for k in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(1, 60), i % 3) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((None if i % 9 == 0 else i % 40 if i % 4 == 0 else i, " ".join(parts), "s"))
    rows += [rows[7], rows[9], (None, rows[9][1], "t"), (5, None, "s"), (6, "", "s")]
    docs = documents(rows)
    hashed = {(r.doc_id, r.text): r.h for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    want = spans_by_brute_force([(k, t, h) for (k, t), h in hashed.items()])
    assert len(want) > 20 and sum(k is None for k, _ in want) > 1
    texts = {(k, h): t for (k, t), h in hashed.items()}
    got = {}
    for r in D.spans(docs).collect():
        got.setdefault((r.doc, texts[r.doc, r.h]), []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == want
    left = {}
    for k, t, _ in rows:
        data, at, kept = (t or "").encode(), 0, b""
        for a, b in want.get((k, t), []):
            kept, at = kept + data[at:a], b
        left.setdefault(k, []).append(None if t is None else (kept + data[at:]).decode())
    clash = docs.withColumns({"doc": F.lit("a"), "h": F.lit("b"), "gone": F.lit(1), "row": F.lit(2), "text_": F.lit("c")})
    done = {}
    for r in D.deduplicated(clash).collect():
        assert (r.doc, r.h, r.gone, r.row, r.text_) == ("a", "b", 1, 2, "c")
        done.setdefault(r.doc_id, []).append(r.text)
    assert {k: sorted(v, key=str) for k, v in done.items()} == {k: sorted(v, key=str) for k, v in left.items()}


def test_an_id_shared_by_unlike_texts(spark, documents):
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    a, b, c = text(400), text(400), text(400)
    left = [(r.doc_id, r.text) for r in D.deduplicated(documents([(1, a, "s"), (7, b, "s"), (7, f"{text(5)} {a}", "s"), (None, c, "s"), (None, f"{b} {text(30)}", "s")])).collect()]
    assert (7, b) in left and (None, c) in left and (1, a) in left
    assert sorted(len(t) for _, t in left)[:2] < [400, 400]
    named = D.deduplicated(documents([(1, a, "s"), (2, a, "s")]).withColumn("doc_id", F.concat(F.lit("id "), "doc_id")))
    assert sorted(len(r.text) for r in named.collect()) == [0, len(a)]
