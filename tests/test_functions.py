from pyspark.sql import functions as F

from quaestor.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalizers(spark):
    assert value(spark, X.normalize_search(F.lit("Ａ－ｂ　（Ｃ）・ d"))) == "abcd"
    assert value(spark, X.normalize_council(F.lit("  ﾊﾝｶｸ  Ａ\n b "))) == "ハンカク a b"
    assert value(spark, X.normalize_council(F.lit(None).cast("string"))) is None


def test_similarity(spark):
    assert value(spark, X.similarity(F.lit("word"), F.lit("word"))) == 1.0
    assert value(spark, X.similarity(F.lit(""), F.lit("word"))) == 0.0
    assert sorted(value(spark, X.trigrams(F.lit("cat")))) == sorted(["  c", " ca", "cat", "at "])
    assert 0 < value(spark, X.similarity(F.lit("word"), F.lit("two words"))) < 1


def test_hashes(spark):
    assert value(spark, X.fnv1a(F.lit("a"))) == 0xE40C292C and value(spark, X.fnv1a(F.lit("foobar"))) == 0xBF9CF968


def test_terms_and_snippets(spark):
    assert value(spark, X.query_terms(F.lit("Budget, budget for a school.x"), stop=("for",))) == ["budget", "school"]
    assert value(spark, X.snippet(F.lit("x" * 100 + "needle" + "y" * 100), F.lit("needle"), 5)) == "…xxxxxneedleyyyyy…"
    assert value(spark, X.snippet(F.lit("short"), F.lit("none"))) == "short"


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    got = value(spark, X.text_chunks(F.lit(text)))
    assert got == [text[0:1200], text[1080:2280], text[2160:]]
    assert value(spark, X.text_chunks(F.lit(""))) == [] and value(spark, X.text_chunks(F.lit("ab"))) == ["ab"]


def test_numbers(spark):
    assert [value(spark, X.amount(F.lit(v))) for v in (0, 7, 123456, -200000)] == ["0", "7千", "1億2345万6千", "-2億"]
    assert [value(spark, X.clamp_score(F.lit(v).cast("double"))) for v in (49.5, -3.0, 250.0, float("nan"))] == [50, 0, 100, None]
    assert value(spark, X.leading_int(F.lit("12x"))) is None and value(spark, X.leading_int(F.lit("12"))) == 12
    assert abs(value(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.5**0.5) < 1e-12
    assert value(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_units_above_the_bmp(spark):
    seed = 2166136261
    for unit in (0xD83D, 0xDE00, 0x61):
        seed = (seed ^ unit) * 16777619 % 2**32
    assert value(spark, X.fnv1a(F.lit("\U0001f600a"))) == seed
    assert value(spark, X.fnv1a(F.lit("\U0001f600"))) == 3409036472
    assert value(spark, X.fnv1a(F.lit(""))) == 2166136261 and value(spark, X.fnv1a(F.lit(None).cast("string"))) is None


def test_parts_and_numbers(spark):
    null = F.lit(None).cast("string")
    a = value(spark, X.content_hash(F.lit("a"), null, F.lit("b")))
    assert a != value(spark, X.content_hash(null, F.lit("a"), F.lit("b"))) and a == value(spark, X.content_hash(F.lit("a"), F.lit(""), F.lit("b")))
    for text, want in (("12", 12), ("99999999999", None), ("1\n", None), ("-1", None), ("", None), ("007", 7)):
        assert value(spark, X.leading_int(F.lit(text))) == want
    kinds = {'{"a": 1}': "OBJECT", "[1]": "ARRAY", '"x"': "STRING", "1.5": "NUMBER", "true": "BOOLEAN", "null": "NULL", "{": None}
    assert {k: value(spark, X.json_kind(F.lit(k))) for k in kinds} == kinds


def test_links_terms_and_vectors(spark):
    valid = F.array(F.lit("1"), F.lit("3"))
    assert value(spark, X.linked_references(F.lit("a [ref:1,2,3] b [ref:9] c [ref: x]"), valid)) == "a [1](/ref/1)[3](/ref/3) b  c [ref: x]"
    assert value(spark, X.chunked(F.array(*map(F.lit, range(5))), 2)) == [[0, 1], [2, 3], [4]]
    vector = lambda *x: F.array(*map(F.lit, x))
    assert [value(spark, X.valid_vector(v, 2)) for v in (vector(1.0, 2.0), vector(1.0), vector(1.0, float("nan")), vector(1.0, float("inf")))] == [True, False, False, False]
    assert value(spark, X.family_name_last(F.lit(" a  b　c "))) == "b　c" and value(spark, X.committee_term(F.lit("予算特別委員会"))) == "予算"


def test_nfkc_holds_few_texts_at_once(monkeypatch):
    import unicodedata

    import pyarrow as pa

    from quaestor.functions import text as X

    texts = ["ﾊﾞ" * 50, None, "", "ａ①"] * 30
    monkeypatch.setattr(X, "HELD", 500)
    got = X.nfkc.func(pa.array(texts))
    assert got.to_pylist() == [None if x is None else unicodedata.normalize("NFKC", x) for x in texts]
    assert X.nfkc.func(pa.array([], pa.string())).to_pylist() == []
