"""A day's recommendations: a largest matching of wished tags to items, then pools that fill what is left.

Every order is by a seeded hash, so that a day and a profile always give the same
rows. Joins and orders are Spark's; what meets in one row is bounded by the number of a
profile's wishes and by ``limit``, whatever the number of items. Profiles and items of a
tag meet in one task, where a profile's first items are looked up and not hashed one by
one, so that the work grows with the profiles and with the items, not with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

#: Profiles that ask for one tag and are looked up together; candidates of a lookup handled at once.
CROWD, BLOCK = 100_000, 4_000_000

STATE = "struct<root:int,stack:array<int>,path:array<bigint>,seen:array<bigint>,held:array<bigint>>"


def _step(s: Column, options: Column) -> Column:
    """One look at the tag on top of the stack: it takes a free item, asks the item's holder to move, or gives up.

    ``stack`` has the tags of the path (from 1), ``path`` the items between them, ``held``
    each tag's item. An item is looked at once for each root.
    """
    start = lambda root, held: F.struct(root.alias("root"), F.array(root).alias("stack"), F.array().cast("array<bigint>").alias("path"), F.array().cast("array<bigint>").alias("seen"), held.alias("held")).cast(STATE)
    tag = F.element_at(s["stack"], -1)
    item = F.get(F.filter(F.get(options, tag - 1), lambda x: ~F.array_contains(s["seen"], x)), F.lit(0))
    holder = F.array_position(s["held"], item).cast("int")
    path = F.concat(s["path"], F.array(item))
    moved = F.transform(s["held"], lambda h, i: F.coalesce(F.get(path, F.array_position(s["stack"], (i + 1).cast("int")).cast("int") - 1), h))
    back = F.struct(s["root"].alias("root"), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1).alias("stack"), F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), s["seen"].alias("seen"), s["held"].alias("held")).cast(STATE)
    deeper = F.struct(s["root"].alias("root"), F.concat(s["stack"], F.array(holder)).alias("stack"), path.alias("path"), F.concat(s["seen"], F.array(item)).alias("seen"), s["held"].alias("held")).cast(STATE)
    return (
        F.when(s["root"] > F.size(options), s)
        .when(item.isNull() & (F.size(s["stack"]) == 1), start(s["root"] + 1, s["held"]))
        .when(item.isNull(), back)
        .when(holder == 0, start(s["root"] + 1, moved))
        .otherwise(deeper)
    )


def largest_matching(options: Column) -> Column:
    """Each tag's item, or null, for an array of each tag's items in order of preference: augmenting paths, tag by tag.

    A tag looks at no more items than there are tags before it finds a free one, so
    that items past that many can be left out of ``options``.
    """
    none = F.transform(options, lambda _: F.lit(None).cast("long"))
    one = F.lit(1)
    first = F.struct(one.alias("root"), F.array(one).alias("stack"), F.array().cast("array<bigint>").alias("path"), F.array().cast("array<bigint>").alias("seen"), none.alias("held")).cast(STATE)
    looks = F.size(options) * (F.size(F.array_distinct(F.flatten(options))) + F.size(options) + 1)
    walked = F.aggregate(F.sequence(one, F.greatest(looks, one)), first, lambda s, _: _step(s, options), lambda s: s["held"])
    # Where first choices all differ, each tag takes its own.
    firsts = F.transform(options, lambda x: F.get(x, F.lit(0)))
    return F.when(F.forall(firsts, lambda x: x.isNotNull()) & (F.size(F.array_distinct(firsts)) == F.size(firsts)), firsts).otherwise(walked)


def _continued(state: np.ndarray, text: str) -> np.ndarray:
    """FNV-1a states of 32 bits after the UTF-16 units of a further text."""
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32):
        state = (state ^ unit) * np.uint32(16777619)
    return state


class Lookup:
    """The items that come first after a hash's state, without hashing every item for every state.

    An item's digits are below 64 and change the last six bits of a state alone, so
    for numbers of n characters hash(state) = hash(state % 64) + (state - state % 64) * prime^n modulo
    2^32. For each of the 64 remainders one order of the items serves all states: each starts
    at its own place in it and goes round.
    """

    def __init__(self, items: np.ndarray):
        self.items = np.unique(items)
        texts = self.items.astype("S20")
        size = np.char.str_len(texts)
        self.sizes = [(int(n), np.flatnonzero(size == n)) for n in np.unique(size)]
        self.texts = texts
        #: Remainders whose orders are held together.
        self.step = max(1, min(64, BLOCK // max(1, len(self.items))))
        self.held: tuple[int, list] = (-1, [])

    def orders(self, low: int) -> list[tuple[np.uint32, np.ndarray, np.ndarray]]:
        """For each length of the items: the power of the prime, and for ``step`` remainders from ``low`` on their number with the hashes from them in order, and the items' places."""
        if self.held[0] != low:
            lows = np.arange(low, min(64, low + self.step), dtype=np.uint32)
            out = []
            for n, at in self.sizes:
                characters = self.texts[at].astype(f"S{n}").view(np.uint8).reshape(-1, n)
                h = np.repeat(lows[:, None], len(at), axis=1)
                for c in range(n):
                    h = (h ^ characters[:, c].astype(np.uint32)) * np.uint32(16777619)
                by = np.argsort(h, axis=1, kind="stable")  # places ascend among equals
                keys = (np.arange(len(lows), dtype=np.uint64)[:, None] << np.uint64(32)) | np.take_along_axis(h, by, 1).astype(np.uint64)
                out.append((np.uint32(pow(16777619, n, 1 << 32)), keys.ravel(), at[by].ravel()))
            self.held = (low, out)
        return self.held[1]

    def first(self, states: np.ndarray, needs: np.ndarray, hidden: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state's number, hash, item) of each state's first items, ``needs`` of them, less ``hidden`` of the states ``of``; in order."""
        at = np.searchsorted(self.items, hidden) if len(self.items) else np.zeros(0, int)
        real = at < len(self.items)
        real[real] = self.items[at[real]] == hidden[real]
        out_of = np.unique((of[real].astype(np.uint64) << np.uint64(32)) | at[real].astype(np.uint64))
        wants = needs + np.bincount((out_of >> np.uint64(32)).astype(np.int64), minlength=len(states))
        wants[needs == 0] = 0
        low = states & np.uint32(63)
        found = [[], [], []]
        for least in range(0, 64, self.step):
            rows = np.flatnonzero((wants > 0) & (low // self.step * self.step == least))
            if not len(rows):
                continue
            orders = self.orders(least)
            width = np.cumsum(np.minimum(wants[rows], len(self.items)) * len(orders))
            for part in np.split(rows, np.flatnonzero(np.diff(width // BLOCK)) + 1):
                keys, places = [], []
                kind = (low[part] - np.uint32(least)).astype(np.uint64)
                for power, hashes, home in orders:
                    size = len(hashes) // min(self.step, 64 - least)
                    shift = (states[part] - low[part]) * power
                    begin = np.searchsorted(hashes, (kind << np.uint64(32)) | (np.uint32(0) - shift).astype(np.uint64)) - kind.astype(np.int64) * size
                    most = np.minimum(wants[part], size)
                    within = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
                    where = (np.repeat(begin, most) + within) % size + np.repeat(kind.astype(np.int64) * size, most)
                    h = hashes[where].astype(np.uint32) + np.repeat(shift, most)
                    keys.append((np.repeat(part, most).astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64))
                    places.append(home[where])
                key, place = np.concatenate(keys), np.concatenate(places)
                if len(out_of):
                    open_ = ~np.isin((key >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64), out_of)
                    key, place = key[open_], place[open_]
                by = np.lexsort((place, key))
                key, place = key[by], place[by]
                state = (key >> np.uint64(32)).astype(np.int64)
                kept = np.arange(len(state)) - np.searchsorted(state, state) < needs[state]
                for values, more in zip(found, (state[kept], (key[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64), self.items[place[kept]]), strict=True):
                    values.append(more)
        state, h, item = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
        by = np.argsort(state, kind="stable")
        return state[by], h[by], item[by]


def hashes(texts: list[str]) -> np.ndarray:
    """FNV-1a of 32 bits over the UTF-16 units of texts, all at once; as ``functions.text.fnv1a``."""
    narrow = [t if t.isascii() or max(t) < "\U00010000" else "".join(map(chr, np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").tolist())) for t in texts]
    length = np.array([len(t) for t in narrow], int)
    codes = np.array(narrow, dtype=f"U{max(1, length.max(initial=0))}").view(np.uint32).reshape(len(narrow), max(1, length.max(initial=0)))
    h = np.full(len(narrow), 2166136261, np.uint32)
    for c in range(codes.shape[1]):
        h = np.where(c < length, (h ^ codes[:, c]) * np.uint32(16777619), h)
    return h


@F.arrow_udf(LongType())
def _hashed(text: pa.Array) -> pa.Array:
    return pa.array(hashes(text.to_pylist()).astype(np.int64))


def _looked_up(asked: pa.Table, items: pa.Table, first: int, limit: int) -> pa.Table:
    """The rows of ``asked`` of one tag with what they need of its items: options of a wish, and the first of each pool with their hashes."""
    tag = asked.column("tag")[0].as_py()
    column = lambda name, kind: asked.column(name).to_numpy().astype(kind)
    seeds, wishes, wished, under = hashes(asked.column("seed").to_pylist()), column("wishes", np.int64), column("wished", bool), column("under", bool)
    hidden = asked.column("hidden").combine_chunks()
    of = np.repeat(np.arange(asked.num_rows), hidden.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = Lookup(items.column("item").to_numpy())

    def listed(name: str, needs: np.ndarray, scored: bool) -> pa.Array:
        state, h, item = known.first(_continued(seeds, f":{name}:"), needs, hidden.flatten().to_numpy(zero_copy_only=False).astype(np.int64), of)
        offsets = np.searchsorted(state, np.arange(asked.num_rows + 1)).astype(np.int32)
        values = pa.array(item, pa.int64())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h, pa.int64()), values], names=["h", "item"]) if scored else values)

    return pa.table({
        "profile": asked.column("profile"),
        "rank": pa.array(_continued(seeds, f":tag-priority:{tag}").astype(np.int64)),
        "place": asked.column("place"),
        "options": listed(f"tag:{tag}", wishes * wished, False),
        "own": listed("selected-fill", first * wished.astype(np.int64), True),
        "rest": listed("parent-unselected", limit * (under & ~wished).astype(np.int64), True),
        "every": listed("parent-all", limit * under.astype(np.int64), True),
    })


def daily(wishes: DataFrame, parents: DataFrame, tagged: DataFrame, shown: DataFrame, day: str, limit: int = 5, first: int = 3, crowd: int = CROWD) -> DataFrame:
    """(profile, place, item, source): up to ``limit`` items for each profile with one that fits, places from 1.

    ``wishes`` has (profile, tag, place), ``parents`` (profile, tag) of the tags under the
    chosen categories, ``tagged`` (item, tag), ``shown`` (profile, item) of what isn't to
    come again. Repeated rows count once; rows with a null fit nothing. As many wishes as
    can be have an item of their own; then items of any wish fill up to ``first``, those
    under the parents that no wish names, and those under the parents up to ``limit``. The
    seed of a profile is the day and its id. Items are longs; a tag that more than ``crowd`` profiles
    ask for is looked up in parts.
    """
    seed = F.concat_ws(":", F.lit(day), F.col("profile").cast("string"))
    first = min(first, limit)
    ours = wishes.select("profile", "tag", "place", F.lit(True).alias("wished"), F.lit(False).alias("under"))
    theirs = parents.select("profile", "tag", F.lit(None).cast(wishes.schema["place"].dataType).alias("place"), F.lit(False).alias("wished"), F.lit(True).alias("under"))
    asked = ours.unionByName(theirs).dropna(subset=["profile", "tag"]).groupBy("profile", "tag").agg(F.min("place").alias("place"), F.max("wished").alias("wished"), F.max("under").alias("under"))
    pairs = tagged.select(F.col("item").cast("long").alias("item"), "tag").dropna()

    # What has been shown of the tags that a profile asks for: of others' items it isn't needed. Codes that collide only hide what has been shown.
    code = F.xxhash64("tag").alias("code")
    met = shown.select("profile", F.col("item").cast("long").alias("item")).dropna().join(pairs.select("item", code), "item").join(asked.select("profile", code), ["profile", "code"], "left_semi")
    hidden = met.groupBy("profile", "code").agg(F.collect_set("item").alias("hidden"))
    counted = asked.withColumn("wishes", F.count(F.when(F.col("wished"), 1)).over(W.partitionBy("profile"))).withColumns({"seed": seed, "code": F.xxhash64("tag")})
    counted = counted.join(hidden, ["profile", "code"], "left").withColumn("hidden", F.coalesce("hidden", F.array().cast("array<bigint>")))
    # No more tags than profiles' wishes by the size of a crowd.
    crowded = F.broadcast(asked.groupBy("tag").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    left = counted.join(crowded, "tag", "left").withColumn("part", F.pmod(F.xxhash64("profile"), parts).cast("int")).select("tag", "part", "profile", "place", "wished", "under", "wishes", "seed", "hidden")
    right = pairs.join(crowded, "tag", "left").select("tag", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "item")
    of = {f.name: f.dataType.simpleString() for f in left.schema}
    scored = "array<struct<h:bigint,item:bigint>>"

    def look(asked: pa.Table, items: pa.Table) -> pa.Table:
        empty = pa.table({"profile": asked.column("profile"), "rank": pa.nulls(asked.num_rows, pa.int64()), "place": asked.column("place")}).slice(0, 0)
        if asked.num_rows and items.num_rows:
            return _looked_up(asked, items, first, limit)
        listed = pa.list_(pa.struct([("h", pa.int64()), ("item", pa.int64())]))
        for name, kind in (("options", pa.list_(pa.int64())), ("own", listed), ("rest", listed), ("every", listed)):
            empty = empty.append_column(name, pa.array([], kind))
        return empty

    found = left.groupBy("tag", "part").cogroup(right.groupBy("tag", "part")).applyInArrow(look, f"profile {of['profile']}, rank bigint, place {of['place']}, options array<bigint>, own {scored}, rest {scored}, every {scored}")
    # A pool needs no more than its target: as many of them as are chosen already may be skipped.
    pool = lambda name, most: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))), 1, most)["item"]
    options = F.sort_array(F.collect_list(F.when(F.size("options") > 0, F.struct("rank", "place", "options"))))["options"]
    filled = found.groupBy("profile").agg(options.alias("options"), pool("own", first).alias("selected_fill"), pool("rest", limit).alias("parent_unselected"), pool("every", limit).alias("parent_all"))

    def topped(chosen: Column, more: Column, target: int) -> Column:
        return F.concat(chosen, F.slice(F.filter(more, lambda x: ~F.array_contains(chosen, x)), F.lit(1), F.greatest(F.lit(target) - F.size(chosen), F.lit(0))))

    chosen = filled.withColumn("own", F.array_compact(largest_matching(F.col("options"))))
    chosen = chosen.withColumn("own", topped(F.col("own"), F.col("selected_fill"), first))
    chosen = chosen.withColumn("most", topped(F.col("own"), F.col("parent_unselected"), limit))
    chosen = chosen.withColumn("most", F.slice(topped(F.col("most"), F.col("parent_all"), limit), 1, limit))
    picks = chosen.select("profile", F.size("own").alias("n_own"), F.posexplode("most").alias("at", "item")).withColumn("draw", _hashed(F.concat_ws(":", seed, F.lit("final"), F.col("item").cast("string"))))
    place = F.row_number().over(W.partitionBy("profile").orderBy("draw", "at"))
    source = F.when(F.col("at") < F.col("n_own"), "selected-subcategory").otherwise("parent-category")
    return picks.select("profile", place.cast("long").alias("place"), "item", source.alias("source"))
