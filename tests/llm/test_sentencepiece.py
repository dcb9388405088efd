import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quaestor.llm import op06_sentencepiece as S


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["", None, " ", "  a", "a  b   c", " " * 40 + "x" + " " * 17, "\n\n\t x\r\ny", "漢字かな混じり文", "aaaa" * 30, "x" * 3000, "é€😀\u0000z", "def f(x):\n        return  x", "the the the of of"]
    made += ["".join(rng.choice("abcdeinrst eto \n") for _ in range(400)) for _ in range(20)]
    return made + made[-3:]


def run(spark, texts, model, **more):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in S.decoded(S.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model, **more), model).collect()}


@pytest.mark.parametrize("held", [1 << 20, 20, 0])
def test_bpe_is_the_library(spark, texts, held):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    got = run(spark, texts, S.Model.load(S.MODEL), held=held)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or "") and got[i].decoded == (t or "")


def test_viterbi_is_the_library(spark, texts, tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(S.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = S.UNIGRAM
    for p in proto.pieces:  # within the precision of the library's sums
        p.score = max(p.score, -40000.0)
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    some = [t for t in texts if "x" * 99 not in (t or "") and "   " not in (t or "")]
    for held in (1 << 20, 0):
        got = run(spark, some, S.Model.load(str(tmp_path / "unigram.model")), held=held)
        scores = {p.piece: p.score for p in proto.pieces}
        total = lambda ids, at=library: sum(scores[at.id_to_piece(i)] for i in ids)
        for i, t in enumerate(some):
            want = library.encode(t or "")
            assert list(got[i].ids) == want or total(got[i].ids) == pytest.approx(total(want)), t


def test_empty_table(spark, documents):
    model = S.Model.load(S.MODEL)
    assert S.decoded(S.encoded(documents([]), model), model).count() == 0


def test_decoding_bytes(spark):
    model = S.Model.load(S.MODEL)
    df = spark.createDataFrame([([model.bytes[0xFF]],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in S.decoded(df, model).collect()] == ["�", "", None]
    assert S.decoded(df.withColumn("decoded", F.lit(1)), model).columns == ["ids", "decoded"]
