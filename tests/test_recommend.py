import random
from quaestor.operators import recommend as R

def fnv(s):
    h = 2166136261
    for i in range(0, len(b := s.encode("utf-16-le")), 2):
        h = (h ^ int.from_bytes(b[i:i+2], "little")) * 16777619 % 2**32
    return h

def brute(wish, parent, tags, shown, seed, limit=5, first=3):
    """Recursion over all items; ``tags`` maps items to sets."""
    order = lambda xs, s: sorted(xs, key=lambda x: fnv(f"{s}:{x}"))
    items = [i for i in sorted(tags) if i not in shown]
    todo = order(list(dict.fromkeys(wish)), f"{seed}:tag-priority")
    holder = {}

    def find(t, seen):
        for i in order([i for i in items if t in tags[i]], f"{seed}:tag:{t}"):
            if i in seen:
                continue
            seen.add(i)
            if i not in holder or find(holder[i], seen):
                holder[i] = t
                return True
        return False

    for t in todo:
        find(t, set())
    chosen = {i: "selected-subcategory" for t in todo for i, held in holder.items() if held == t}
    for name, fits, most, source in [
        ("selected-fill", lambda s: s & set(wish), min(first, limit), "selected-subcategory"),
        ("parent-unselected", lambda s: s & (set(parent) - set(wish)), limit, "parent-category"),
        ("parent-all", lambda s: s & set(parent), limit, "parent-category"),
    ]:
        for i in order([i for i in items if fits(tags[i])], f"{seed}:{name}"):
            if len(chosen) < most:
                chosen.setdefault(i, source)
    kept = dict(list(chosen.items())[:limit])
    return [(i, kept[i]) for i in order(kept, f"{seed}:final")]


def test_daily_by_brute_force(spark):
    rng = random.Random(5)
    names = [f"t{i}" for i in range(12)]
    tags = {i: set(rng.sample(names[:9], rng.randint(0, 3))) for i in range(40)}
    wish = {p: rng.sample(names, rng.randint(0, 7)) for p in range(60)}
    parent = {p: rng.sample(names, rng.randint(0, 4)) for p in range(60)}
    shown = {p: set(rng.sample(sorted(tags), rng.choice([0, 10, 30, 37]))) for p in range(60)}
    frame = lambda rows, s: spark.createDataFrame(rows * 2, s)
    got = R.daily(
        frame([(p, t, i) for p, ts in wish.items() for i, t in enumerate(ts)] + [(None, "t1", 0)], "profile long, tag string, place int"),
        frame([(p, t) for p, ts in parent.items() for t in ts], "profile long, tag string"),
        frame([(i, t) for i, ts in tags.items() for t in ts] + [(7, None)], "item long, tag string"),
        frame([(p, i) for p, xs in shown.items() for i in xs], "profile long, item long"), "2026-05-01").orderBy("profile", "place").collect()
    want = [(p, n + 1, *x) for p in range(60) for n, x in enumerate(brute(wish[p], parent[p], tags, shown[p], f"2026-05-01:{p}"))]
    assert [tuple(r) for r in got] == want
    assert max(sum(w[0] == p for w in want) for p in range(60)) == 5


def test_lookup_needs_no_hash_of_every_pair(spark):
    import numpy as np

    rng = random.Random(6)
    items = np.array(sorted({rng.choice([1, -1]) * rng.randrange(10 ** rng.randint(1, 18)) for _ in range(300)}))
    states = np.array([rng.randrange(2**32) for _ in range(200)], np.uint32)
    needs = np.array([rng.choice([0, 1, 4, 400]) for _ in states])
    gone = [(q, int(i)) for q in range(0, 200, 3) for i in rng.sample(list(items), 40)] + [(1, 12345)]

    def on(state, item):
        for c in str(item).encode():
            state = (state ^ c) * 16777619 % 2**32
        return state

    q, h, i = R.Lookup(np.repeat(items, 2)).first(states, needs, np.array([x for _, x in gone]), np.array([n for n, _ in gone]))
    want = [(n, *x) for n, s in enumerate(states.tolist()) for x in sorted((on(s, int(x)), int(x)) for x in items if (n, int(x)) not in set(gone[n // 3 * 40 : n // 3 * 40 + 40]))[: needs[n]]]
    assert list(zip(q.tolist(), h.tolist(), i.tolist())) == want


def test_daily_of_a_crowded_tag_in_parts(spark):
    wishes = spark.createDataFrame([(p, "t", 0) for p in range(40)], "profile long, tag string, place int")
    parents, shown = wishes.select("profile", "tag"), spark.createDataFrame([(p, p + 5) for p in range(40)], "profile long, item long")
    tagged = spark.createDataFrame([(i, "t") for i in range(60)], "item long, tag string")
    rows = lambda **more: sorted(tuple(r) for r in R.daily(wishes, parents, tagged, shown, "d", **more).collect())
    want = sorted((p, n + 1, *x) for p in range(40) for n, x in enumerate(brute(["t"], ["t"], {i: {"t"} for i in range(60)}, {p + 5}, f"d:{p}")))
    assert rows() == rows(crowd=7) == want


def test_hashes_of_many_texts():
    texts = ["", "a", "Brand#1/5", "é·語", "x\U0001F600y", "tail\0"]
    assert R.hashes(texts).tolist() == [fnv(t) for t in texts] and R.hashes([]).tolist() == []
