"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's
target over its source's size. The whole part is granted outright. The fractions
are rounded in pairs: expected mass (size times fraction) moves between two
documents, in a random direction that leaves both expectations alone, until one
of them has all or none. Each small bucket of a source is folded so to a single
undecided document, the undecided ones of neighbouring buckets are folded
again, and so on up a tree, so that each source's total stays within one
document of its target. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, boxed, cut, running, unboxed, without

#: Documents folded in one group.
BUCKET = 64


def targets(sizes: DataFrame, source: str, weights: tuple[float, ...], budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    ``budget`` times all sizes. No target is above ``most`` times its source's
    size: what is over goes to the others by weight until none is above. That fixed
    point is level * weight, capped, where the level follows from running sums over
    the sources in the order in which their caps bind.
    """
    ranked = running(sizes, [F.col(source).asc_nulls_last()], _rank=F.lit(1))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"_w": share, "_cap": F.col("source_size") * float(most)}).withColumn("_binds", F.col("_cap") / F.col("_w"))
    bound = running(capped, [F.col("_binds"), F.col("_rank")], _caps=F.col("_cap"), _ws=F.col("_w"))
    total = bound.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("t"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("w")).first()
    mass, weight = total["t"] * budget, total["w"]
    level = (F.lit(mass) - F.col("_caps")) / (F.lit(weight) - F.col("_ws"))
    # The level at the first source whose cap doesn't bind holds for all that follow.
    free = bound.where(level <= F.col("_binds")).agg(F.min_by(level, F.struct("_binds", "_rank")).alias("level")).first()["level"]
    at = F.lit(float("inf") if free is None else free)
    return bound.select(source, "source_size", F.least(F.col("_cap"), at * F.col("_w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _step(seed: int):
    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        up = F.least(a["mass"] - a["x"], b["x"])
        down = F.least(a["x"], b["mass"] - b["x"])
        rise = _uniform(a["h"], b["h"], F.lit(seed)) * (up + down) < down
        # The pair's mass goes to a first if it rises, else to b first; one of the two is settled.
        first, second = F.when(rise, a).otherwise(b), F.when(rise, b).otherwise(a)
        both = a["x"] + b["x"]
        full = both >= first["mass"]
        settled = F.when(full, first).otherwise(second)
        rest = F.when(full, second).otherwise(first)
        return F.struct(
            F.struct(rest["order"].alias("order"), rest["h"].alias("h"), rest["key"].alias("key"), rest["size"].alias("size"), rest["mass"].alias("mass"), F.when(full, both - first["mass"]).otherwise(both).alias("x")).alias("open"),
            F.concat(state["done"], F.array(F.struct(settled["key"].alias("key"), settled["size"].alias("size"), full.cast("int").alias("take")))).alias("done"),
        )

    return step


def _fold(items: Column, seed: int, done_type: str) -> Column:
    start = F.struct(items[0].alias("open"), F.array().cast(done_type).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, _step(seed))


def settle(units: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """(source, key, size, take) for units with ``h``, ``mass``, ``x`` and ``bucket``."""
    widest = units.agg(F.max("bucket")).first()[0] or 0
    done_type = f"array<struct<key:{dict(units.dtypes)[key]},size:bigint,take:int>>"
    # Large documents go first: the small ones that follow settle them.
    item = F.struct((-F.col("mass")).alias("order"), "h", F.col(key).alias("key"), "size", "mass", "x")
    level, out, depth = units.select(source, "bucket", item.alias("item")), [], 0
    while True:
        folded = level.groupBy(source, "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = cut(folded.select(source, "bucket", _fold(F.col("items"), seed + depth, done_type).alias("s")))
        out.append(folded.select(source, F.explode("s.done").alias("d")).select(source, "d.*"))
        if widest == 0:
            last = F.col("s.open")
            take = (_uniform(last["h"], F.lit(seed)) * last["mass"] < last["x"]).cast("int")
            out.append(folded.select(source, last["key"].alias("key"), last["size"].alias("size"), take.alias("take")))
            break
        level = folded.select(source, F.floor(F.col("bucket") / BUCKET).alias("bucket"), F.col("s.open").alias("item"))
        widest, depth = widest // BUCKET, depth + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.withColumnRenamed("key", key)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.0, most: float = 3.0, seed: int = 20) -> DataFrame:
    """``docs`` with ``copies``, ``source_size`` and ``target``.

    ``size`` is a long of 0 or more. Of ``n`` rows that agree in key, source and size,
    as many take one copy more as ``n`` times their fraction makes whole; what is left
    is one document's draw. Null keys and null sources are values like any other. A
    row of size 0, or of a null size, gets no copy. An empty table gives an empty
    result. Columns of the three names that ``docs`` may have are replaced, those that
    begin with _d go. The draw depends on keys, sources, sizes and ``seed`` alone, and
    which of several such rows take more on what else they hold.
    """
    base = docs.select(F.col(key).alias("_key"), F.col(source).alias("_src"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    units = cut(base.groupBy("_key", "_src", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("_src").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("_n"))
    sizes = cut(sizes)
    goal = targets(sizes.select("_src", "source_size"), "_src", weights, budget, most)
    goal = cut(goal.join(sizes.select(F.col("_src").alias("_s"), "_n"), F.col("_src").eqNullSafe(F.col("_s"))).drop("_s"))
    u, g = units.alias("u"), goal.withColumnRenamed("_src", "_gs").alias("g")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(F.col("rate"))
    whole = F.when(F.abs(F.col("rate") - near) < 1e-9, near).otherwise(F.floor("rate"))
    part = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    buckets = F.ceil(F.col("_n") / BUCKET)
    rated = u.join(g, F.col("u._src").eqNullSafe(F.col("g._gs"))).drop("_gs").withColumn("rate", rate).withColumn("whole", whole.cast("int")).withColumn("share", part * F.col("rows"))
    rated = rated.withColumn("granted", F.floor(F.col("share") + 1e-9)).withColumn("part", F.greatest(F.col("share") - F.col("granted"), F.lit(0.0)))
    rated = rated.withColumn("mass", F.col("size").cast("double")).withColumn("h", F.xxhash64("_key", "_src", "size", F.lit(seed)))
    rated = cut(rated.withColumn("x", F.col("mass") * F.col("part")).withColumn("bucket", F.pmod(F.xxhash64("h"), buckets)).drop("rate", "share", "_n"))
    drawn = rated.where((F.col("part") > 0) & (F.col("mass") > 0))
    taken = settle(drawn, "_src", "_key", seed).select(F.col("_key").alias("_tk"), F.col("_src").alias("_ts"), F.col("size").alias("_tz"), "take")
    same = F.col("_key").eqNullSafe(F.col("_tk")) & F.col("_src").eqNullSafe(F.col("_ts")) & (F.col("size") == F.col("_tz"))
    no = F.col("size") == 0
    decided = rated.join(taken, same, "left").select(F.col("_key").alias("_dk"), F.col("_src").alias("_ds"), F.col("size").alias("_dz"), F.col("rows").alias("_dn"), F.when(no, 0).otherwise(F.col("whole")).alias("copies"), F.when(no, 0).otherwise(F.col("granted") + F.coalesce("take", F.lit(0))).alias("_dx"), "source_size", "target")
    repeated = not units.where("rows > 1").isEmpty()
    decided = cut(decided) if repeated else decided
    rows = without(docs, "copies", "source_size", "target", "_dk", "_ds", "_dz", "_dn", "_dx", "_dh", "_di", "_dp", "_d0")

    def given(of: DataFrame) -> DataFrame:
        match = rows[key].eqNullSafe(F.col("_dk")) & rows[source].eqNullSafe(F.col("_ds")) & (F.coalesce(rows[size].cast("long"), F.lit(0)) == F.col("_dz"))
        return rows.join(of, match)

    once = given(decided.where("_dn = 1") if repeated else decided).withColumn("copies", (F.col("copies") + F.col("_dx")).cast("int"))
    out = once.drop("_dk", "_ds", "_dz", "_dn", "_dx")
    if not repeated:
        return out
    # Of rows that agree, the first in this order take one copy more; ranges split them, however many there are.
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    many = given(decided.where("_dn > 1")).withColumns({"_dh": F.xxhash64(*plain), "_di": F.monotonically_increasing_id()})
    many = cut(running(many, [F.col(c) for c in ("_dk", "_ds", "_dz", "_dh", "_di")], _dp=F.lit(1)))
    first = many.groupBy(F.col("_dk").alias("_tk"), F.col("_ds").alias("_ts"), F.col("_dz").alias("_tz")).agg(F.min("_dp").alias("_d0"))
    placed = many.join(first, F.col("_dk").eqNullSafe(F.col("_tk")) & F.col("_ds").eqNullSafe(F.col("_ts")) & (F.col("_dz") == F.col("_tz")))
    more = placed.withColumn("copies", (F.col("copies") + (F.col("_dp") - F.col("_d0") < F.col("_dx")).cast("int")).cast("int"))
    return out.unionByName(more.select(*out.columns))


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``size``, the number of words of the whole text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(word_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    mixed = mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` mixed to the weights: a document stands there as often as the mix takes it, its columns unchanged, whatever their names.

    Null keys and sources are values like any other; texts without words are taken
    by no mix; of rows that agree in id, source and size as many are taken as their
    number and fraction make whole, with one draw for what is left. An empty table
    gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mixed = mix(boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=size)).where("copies > 0")
    return unboxed(mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))), docs)
