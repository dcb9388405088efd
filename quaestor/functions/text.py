"""Column functions on text: normalizers, similarity, hashes, snippets, chunks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Characters of text, about, that are held as Python strings at once.
HELD = 1_000_000


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC; Spark has no such function. A batch's texts become Python strings in small parts, whatever their length."""
    out, step = [], max(1, HELD * len(text) // max(1, text.nbytes))
    for at in range(0, len(text), step):
        out.append(pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.slice(at, step).to_pylist()], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def normalize_search(text: Column, unicode: bool = True) -> Column:
    """For budget search: NFKC, without spaces, dashes, dots and brackets, lower case. ``unicode=False`` for texts known to be ASCII."""
    return F.lower(F.regexp_replace(nfkc(text) if unicode else text, r"[\s\-‐-―−ー・･.,()\[\]]+", ""))


def normalize_council(text: Column, unicode: bool = True) -> Column:
    """For council search: NFKC, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text) if unicode else text), r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each word, padded with two blanks before and one after."""
    parts = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    grams = F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams, 0 to 1."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def utf16_units(text: Column) -> Column:
    """The UTF-16 units of a text, as numbers; characters above the BMP have two."""
    octets = F.hex(F.encode(text, "UTF-16BE"))
    units = F.sequence(F.lit(0), (F.length(octets) / 4).cast("int") - 1)
    spelled = F.transform(units, lambda i: F.conv(F.substring(octets, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.when(F.length(octets) == 0, F.array().cast("array<bigint>")).otherwise(spelled)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units."""
    step = lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295)
    return F.aggregate(utf16_units(text), F.lit(2166136261), step)


def query_terms(query: Column, stop: tuple[str, ...] = (), most: int = 16) -> Column:
    """Distinct terms of 2 to 40 characters, less stop words, the first ``most``."""
    parts = F.split(F.lower(query), r"[\s,.;:!?、。・「」()\[\]/]+")
    kept = F.filter(parts, lambda t: F.length(t).between(2, 40) & ~t.isin(*stop) if stop else F.length(t).between(2, 40))
    return F.slice(F.array_distinct(kept), 1, most)


def snippet(content: Column, term: Column, radius: int = 40) -> Column:
    """The text around a term's first occurrence, with ellipses where it is cut; its beginning if there is none."""
    at = F.instr(F.lower(content), F.lower(term))
    start = F.greatest(at - radius, F.lit(1))
    size = F.when(at > 0, F.length(term) + at - start + radius).otherwise(F.lit(2 * radius))
    body = F.substring(content, start, size)
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + size <= F.length(content), "…").otherwise(""))


def text_chunks(content: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the last one's end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(content) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * step + 1, F.lit(size))))


def leading_int(text: Column) -> Column:
    """The integer that a text spells; null for any other text and for what an int can't hold."""
    return F.when(text.rlike(r"\A[0-9]+\z"), text).try_cast("int")


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts with NUL between them; a null part counts as an empty one, in its place."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def json_kind(text: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, NUMBER or NULL, by the value itself; null for what is no JSON."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), "^[A-Z]+", 0)
    return F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").when(kind == "VOID", "NULL").otherwise(kind)


# The characters that candidates write as one middle dot, and as one dash.
MIDDLE_DOTS = "[･·]"
DASHES = "[‐‑‒–—―ｰー]"


def normalize_candidate(text: Column) -> Column:
    """For candidates: NFKC, without spaces, one middle dot and one dash for all, long vowel marks among the dashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(nfkc(text), r"[\s\x{A0}\x{3000}]+", ""), MIDDLE_DOTS, "・"), DASHES, "-")


def normalize_person(name: Column) -> Column:
    """A person's name: NFKC, without spaces and what stands in brackets."""
    return F.regexp_replace(F.regexp_replace(nfkc(name), r"\([^)]*\)", ""), r"\s+", "")


def family_name_last(name: Column) -> Column:
    """A name's last part between blanks; null for none."""
    return F.nullif(F.element_at(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "), -1), F.lit(""))


def committee_term(name: Column) -> Column:
    """What to search a committee by: its name without its kind."""
    return F.regexp_replace(F.trim(name), "(特別|常任)?委員会$", "")


def inline(text: Column) -> Column:
    """A text on one line, single-spaced."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def summary_points(points: Column, most: int = 3) -> Column:
    """The first points that aren't blank, trimmed."""
    return F.slice(F.filter(F.transform(points, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def expanded_terms(terms: Column, aliases: Column) -> Column:
    """Terms and what a map of aliases has for them, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.get(F.array(aliases[t]), F.lit(0)), F.array().cast("array<string>"))))))


def chunked(values: Column, size: int) -> Column:
    """An array in pieces of ``size``."""
    last = F.greatest(F.ceil(F.size(values) / size).cast("int") - 1, F.lit(0))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, size))).otherwise(F.array())


def valid_vector(vector: Column, dimension: int) -> Column:
    """Whether a vector has that many numbers, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def linked_references(text: Column, valid: Column, url: str = "/ref/") -> Column:
    """``[ref:1,2]`` as links to those of its numbers that are in ``valid``, an array of strings; a group without one goes."""
    split = F.split(F.regexp_replace(text, r"\[ref:([0-9, ]+)\]", "\1$1\1"), "\1")
    links = lambda group: F.array_join(F.transform(F.filter(F.split(group, r"[, ]+"), lambda n: F.array_contains(valid, n)), lambda n: F.concat(F.lit("["), n, F.lit(f"]({url}"), n, F.lit(")"))), "")
    return F.array_join(F.transform(split, lambda part, i: F.when(i % 2 == 1, links(part)).otherwise(part)), "")


def canonical_tag(tag: Column, aliases: Column, known: tuple[str, ...]) -> Column:
    """A trimmed tag under its alias, if it is a known one."""
    named = F.coalesce(aliases[F.trim(tag)], F.trim(tag))
    return F.when(named.isin(*known), named)


def amount(value: Column) -> Column:
    """Thousands as 億, 万 and 千 units, signed."""
    size = F.abs(value)
    oku, man, sen = F.floor(size / 100000), F.floor(size % 100000 / 10), size % 10
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit))).otherwise("")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.when(size == 0, "0").otherwise(F.concat(part(oku, "億"), part(man, "万"), part(sen, "千"))))


def yen(thousands: Column) -> Column:
    """An amount in thousands of yen in units of 10^8, 10^4 and 10^3 yen, grouped by commas; null beyond 2^53, as a double can't hold it."""
    v = F.when(F.abs(thousands) < 2**53, F.abs(thousands).cast("long"))
    oku, man, rest = F.floor(v / 100_000), F.floor(v % 100_000 / 10), v % 10
    part = lambda n, unit: F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(unit))).otherwise("")
    said = F.concat(part(oku, "億"), part(man, "万"), part(rest, "千"))
    return F.when(v.isNotNull(), F.concat(F.when(thousands < 0, "−").otherwise(""), F.when(said == "", "0").otherwise(said), F.lit("円")))


def yen_difference(thousands: Column) -> Column:
    """A difference in thousands of yen with its sign; null beyond 2^53."""
    v = F.when(F.abs(thousands) < 2**53, thousands.cast("long"))
    return F.concat(F.when(v > 0, "+").when(v < 0, "−").otherwise(""), F.format_number(F.abs(v), 0), F.lit(" 千円"))


def fiscal_year(year: Column) -> Column:
    """A fiscal year by its era from 2019 on, by its number before."""
    return F.concat(F.when(year >= 2019, F.concat(F.lit("令和"), (year - 2018).cast("string"))).otherwise(year.cast("string")), F.lit("年度"))


def clamp_score(value: Column) -> Column:
    """Rounded half up and held to 0..100; null for null and what is no number."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(value + 0.5)))).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def name_uuid(name: Column) -> Column:
    """The id of a name: the first 16 bytes of its SHA-1 as a UUID, with the marks of version 5."""
    h = F.sha1(name.cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
