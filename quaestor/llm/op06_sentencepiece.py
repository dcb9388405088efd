"""SentencePiece encoding and decoding over a relational lattice.

Texts are taken apart into segments that no piece of the model crosses. The
distinct segments' substrings of bounded length are exploded and joined to the
table of pieces; the matches are a segment's lattice. Its edges are grouped by
segment and folded with a higher-order aggregate: Viterbi for a unigram model, and
merges in order of rank for a BPE model, whose encoding isn't the path of the best
score. Encoding a text then is looking up its segments. Segments that are too rare
or too long for the shared table are merged in place by the same rule.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import Lookup, boxed, cut, let, small_batches, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments of the shared table at most; the most frequent ones.
HELD = 1 << 21
#: Characters of the longest segment that goes through the lattice, and of its longest run of spaces.
LONG, BLANKS = 64, 14
#: Distinct segments that a task gathers before it hands them on, or remembers.
FLUSH = 150_000
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, USER, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0
#: The id of a character that is no piece, above all ids.
NONE = (1 << 24) - 1


@dataclass(frozen=True)
class Model:
    """The pieces of a SentencePiece model with byte fallback and no text normalization."""

    pieces: dict[str, tuple[int, float]]
    scores: dict[str, float]
    bytes: tuple[int, ...]
    texts: tuple[bytes, ...]
    kind: int
    prefix: bool
    lone: str

    @classmethod
    def load(cls, path: str, kind: int | None = None) -> Model:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind, norm = kind or proto.trainer_spec.model_type, proto.normalizer_spec
        if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a unigram or BPE model with byte fallback and identity normalization is needed")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters")
        numbers = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        texts = tuple(bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else b"" for p in proto.pieces)
        inside = "".join(p for p in pieces if len(p) > 1)
        return cls(pieces, {p: s for p, (_, s) in pieces.items()}, tuple(numbers[f"<0x{b:02X}>"] for b in range(256)), texts, kind, norm.add_dummy_prefix, "".join(c for c in "\n\t\r" if c not in inside))

    def segments(self, text: str | None) -> list[str]:
        """Spaces with what follows them, or a character that no longer piece holds."""
        if not text:
            return []
        if "  " in text or "\0" in text or SPACE in text or (self.prefix and text[0] == " "):
            lone = re.escape(self.lone)
            form = f"[{lone}]|{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" if lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
            return re.findall(form, SPACE * self.prefix + text.replace(" ", SPACE))
        text = SPACE * self.prefix + text.replace(" ", "\0" + SPACE)
        for c in self.lone:
            text = text.replace(c, f"\0{c}\0")
        return list(filter(None, text.split("\0")))

    def spelled(self, tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            if (p := self.pieces.get(t)) is not None:
                out.append(p[0])
            else:
                out += [self.bytes[b] for b in t.encode()]
        return out

    def merged(self, segment: str) -> list[int]:
        """A segment's ids, without the lattice."""
        return self.spelled((_merge(segment, self.scores) if len(segment) <= LONG else _merge_long(segment, self.scores)) if self.kind == BPE else _best(segment, self.pieces))


def _merge(segment: str, scores: dict[str, float]) -> list[str]:
    none, get, parts = float("-inf"), scores.get, list(segment)
    pairs = [get(segment[i : i + 2], none) for i in range(len(segment) - 1)]
    while pairs and (best := max(pairs)) > none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


def _merge_long(segment: str, scores: dict[str, float]) -> list[str]:
    n = len(segment)
    end, before, agenda = list(range(1, n + 1)), list(range(-1, n)), []

    def offer(i: int) -> None:
        if i >= 0 and (m := end[i]) < n and (p := scores.get(segment[i : end[m]])) is not None:
            heapq.heappush(agenda, (-p, i, m, end[m]))

    for i in range(n):
        offer(i)
    while agenda:
        _, i, m, e = heapq.heappop(agenda)
        if end[i] == m and end[m] == e:
            end[i], end[m], before[e] = e, 0, i
            offer(i)
            offer(before[i])
    return [segment[i:e] for i, e in enumerate(end) if e]


def _best(segment: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    longest, unknown = max(map(len, pieces)), min(s for _, s in pieces.values()) - UNKNOWN_PENALTY
    best, back = [0.0, *[float("-inf")] * len(segment)], [0] * (len(segment) + 1)
    for e in range(1, len(segment) + 1):
        for s in range(max(0, e - longest), e):
            score = pieces.get(segment[s:e], (0, unknown if s == e - 1 else float("-inf")))[1]
            if best[s] + score > best[e]:
                best[e], back[e] = best[s] + score, s
    out, e = [], len(segment)
    while e:
        out.append(segment[back[e] : e])
        e = back[e]
    return out[::-1]


def segment_counts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(seg, n): how often each segment stands in the whole texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        hand = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["seg", "n"])
        for batch in batches:
            for x in batch.column(0):
                seen.update(model.segments(x.as_py()))
                if len(seen) > FLUSH:
                    yield hand()
                    seen.clear()
        yield hand()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("string")).mapInArrow(tally, "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))


def lattice(segments: DataFrame, model: Model) -> DataFrame:
    """(seg, edges): the pieces that stand in each segment of LONG characters at most.

    A character alone is an edge even if it is no piece (id NONE). An edge of a BPE
    model is one long, whose order is that of the merges: rank of the score, start,
    end, id. Of a unigram model it is a struct of start, end, score and id.
    """
    spark = segments.sparkSession
    ranks = {s: i for i, s in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
    table = spark.createDataFrame(pa.table({"piece": list(model.pieces), "id": pa.array([i for i, _ in model.pieces.values()], pa.int64()), "score": [s for _, s in model.pieces.values()], "rank": pa.array([ranks[s] for _, s in model.pieces.values()], pa.int64())}))
    longest = max(map(len, model.pieces))
    # Dealt by segment before the explosion, the edges of a segment are together already.
    # Their number is given: the lattice is far larger than the segments by which partitions would be put together.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = segments.repartition(parts, "seg").select("seg", F.explode(F.sequence(F.lit(0), F.length("seg") - 1)).alias("start"))
    spans = starts.select("seg", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("seg") - F.col("start")))).alias("size"))
    named = spans.select("seg", "start", "size", F.substring("seg", F.col("start") + 1, F.col("size")).alias("piece"))
    # The table of pieces is one model's vocabulary, whatever the size of the texts.
    met = named.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    end, number = F.col("start") + F.col("size"), F.coalesce("id", F.lit(NONE))
    if model.kind == BPE:
        edge = F.shiftleft(F.coalesce("rank", F.lit(NONE)), 38).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 31)).bitwiseOR(F.shiftleft(end.cast("long"), 24)).bitwiseOR(number)
    else:
        edge = F.struct("start", end.alias("end"), "score", number.cast("int").alias("id"))
    return met.groupBy("seg").agg(F.collect_list(edge).alias("edges"))


def _spell(model: Model, seg: Column, tokens: Column) -> Column:
    """Ids of ``tokens``, an array with (end, id) at each start of a token and end 0 elsewhere."""
    numbers = F.array(*[F.lit(i) for i in model.bytes])

    def spelled(x: Column, i: Column) -> Column:
        char = F.hex(F.encode(F.substring(seg, i + 1, F.lit(1)), "utf-8"))
        octets = F.transform(F.sequence(F.lit(0), (F.length(char) / 2 - 1).cast("int")), lambda k: F.get(numbers, F.conv(F.substring(char, (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
        return F.when(x["end"] == 0, F.array().cast("array<int>")).when(x["id"] == NONE, octets).otherwise(F.array(x["id"]))

    return F.flatten(F.transform(tokens, spelled))


def _by_rank(edges: Column) -> Column:
    """Merges, the best-ranked edge first: an edge is taken if just two tokens make it up."""
    start = lambda e: F.shiftright(e, 31).bitwiseAND(127).cast("int")
    end = lambda e: F.shiftright(e, 24).bitwiseAND(127).cast("int")
    number = lambda e: e.bitwiseAND(NONE).cast("int")
    # A token is its end and its id; 0 stands where none starts.
    token = (1 << 31) - 1
    singles = F.sort_array(F.transform(F.filter(edges, lambda e: end(e) - start(e) == 1), lambda e: e.bitwiseAND((1 << 38) - 1)))
    singles = F.transform(singles, lambda e: e.bitwiseAND(token))
    order = F.sort_array(F.filter(edges, lambda e: end(e) - start(e) > 1))

    def merge(tokens: Column, e: Column) -> Column:
        middle = end(F.get(tokens, start(e)))
        put = lambda x, i: F.when(i == start(e), e.bitwiseAND(token)).when(i == middle, F.lit(0).cast("long")).otherwise(x)
        return F.when((middle > 0) & (end(F.get(tokens, middle)) == end(e)), F.transform(tokens, put)).otherwise(tokens)

    merged = F.aggregate(order, singles, merge)
    return F.transform(merged, lambda t: F.struct(end(t).alias("end"), number(t).alias("id")))


def _by_score(edges: Column, unknown: float) -> Column:
    """Viterbi: the path of the best sum of scores."""
    length = F.array_max(F.transform(edges, lambda e: e["end"]))
    kind = "struct<score:double,start:int,id:int>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(None).cast("int").alias("id")))

    def reach(best: Column, at: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == at)
        paths = F.transform(into, lambda e: F.struct((F.get(best, e["start"])["score"] + F.coalesce(e["score"], F.lit(unknown))).alias("score"), (-e["start"]).alias("start"), e["id"].alias("id")))
        top = F.array_max(paths)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["start"]).alias("start"), top["id"].alias("id")).cast(kind)))

    def walk(best: Column) -> Column:
        blank = F.transform(F.slice(best, 2, F.size(best)), lambda x: F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("id")))
        start = F.struct(length.alias("at"), blank.alias("tokens"))

        def back(state: Column, _: Column) -> Column:
            step = F.get(best, state["at"])
            put = lambda x, i: F.when(i == step["start"], F.struct(state["at"].alias("end"), step["id"].alias("id"))).otherwise(x)
            return F.when(state["at"] > 0, F.struct(step["start"].alias("at"), F.transform(state["tokens"], put).alias("tokens"))).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), length), start, back)["tokens"]

    return let(F.aggregate(F.sequence(F.lit(1), length), first.cast(f"array<{kind}>"), reach), walk)


def folded(lattices: DataFrame, model: Model) -> DataFrame:
    """(seg, ids) from (seg, edges)."""
    unknown = min(s for _, s in model.pieces.values()) - UNKNOWN_PENALTY
    fold = _by_rank if model.kind == BPE else lambda e: _by_score(e, unknown)
    return lattices.select("seg", let(fold(F.col("edges")), lambda t: _spell(model, F.col("seg"), t)).alias("ids"))


def encoded(docs: DataFrame, model: Model, text: str = "text", held: int = HELD) -> DataFrame:
    """``docs`` with ``ids``, the whole texts' pieces, as the SentencePiece library gives them.

    Empty and null texts have no ids. Repeated rows stay; a column ids is replaced,
    all others stay, whatever their names; an empty table gives an empty result. The table of segments is shared as far as
    ``held`` segments; the least count that keeps within it is chosen from the
    numbers of segments by power of 2 of their counts; it is 2 at least. Segments are looked up by
    their XXH64.
    """
    spark = docs.sparkSession
    # A segment seen once would be shared for nothing.
    counts = cut(segment_counts(docs, model, text).where("n > 1").withColumn("size", F.floor(F.log2("n")).cast("int")))
    least, room = 0, held
    for r in counts.groupBy("size").count().orderBy(F.desc("size")).collect():
        room -= r["count"]
        if room < 0:
            least = r["size"] + 1
            break
    short = (F.length("seg") <= LONG) & ~F.col("seg").startswith(SPACE * (BLANKS + 1))
    table = folded(lattice(counts.where((F.col("size") >= least) & short).select("seg"), model), model)
    # ``held`` bounds the groups of a task, which so needn't be sorted to be formed.
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(held))
    try:
        got = table.select(F.xxhash64("seg").alias("h"), "ids").toArrow()
    finally:
        spark.conf.set(setting, before)
    ids = got.column("ids").combine_chunks()
    ids = ids if isinstance(ids, pa.ListArray) else pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.list_(pa.int32()))
    shared = spark.sparkContext.broadcast((got.column("h").to_numpy(), ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, offsets, flat = shared.value
        flat = flat.tobytes()
        find, known = Lookup(keys, np.arange(len(keys), dtype=float)), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [model.segments(x) for x in part.column("text").to_pylist()]
                if len(known) > FLUSH:
                    known.clear()
                new = list({s for t in texts for s in t}.difference(known))
                where = find(np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in new], np.uint64).view(np.int64))
                at = np.where(np.isnan(where), 0, where).astype(np.int64)
                for s, w, a, b in zip(new, where.tolist(), (4 * offsets[at]).tolist(), (4 * offsets[at + 1]).tolist(), strict=True) if len(keys) else ((s, np.nan, 0, 0) for s in new):
                    known[s] = flat[a:b] if w == w else array("i", model.merged(s)).tobytes()
                rows = [b"".join([known[s] for s in t]) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), column], names=["row", "ids"])

    small_batches(spark)
    rest = without(docs, "ids")
    rows = boxed(rest, text=F.col(f"`{text}`").cast("string"))
    found = rows.mapInArrow(encode, rows.select("row", F.array(F.lit(0)).alias("ids")).schema)
    return found.select("row.*", "ids")


def decoded(rows: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that each array of ids spells. Bytes that are no UTF-8 give the replacement character; no ids and unknown ones give nothing, null gives null."""
    # One literal, folded once: each piece's bytes in hexadecimal.
    pieces = F.from_json(F.lit(json.dumps([x.hex() for x in model.texts])), "array<string>")
    spelled = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")).cast("string"))
    if model.prefix:
        spelled = F.regexp_replace(spelled, "^ ", "")
    return without(rows, text).withColumn(text, spelled)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Model.load(MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decoded(encoded(docs, model), model)
    back = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each document; those without text have no ids. An empty table gives an empty result, other columns go."""
    named = docs.select("doc_id", "lang", "source", "text")
    return encoded(named, Model.load(MODEL)).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
