import pytest
from lakecorpus.operators import tokens as T
from lakecorpus.operators.training_rows import byte_tokens
from pyspark.sql import functions as F

WORD = "ᠮᠣᠩ"


def test_spans():
    text = f"ab {WORD}\u202f{WORD}᠂ \u202fx<bos>{WORD}<nope>"
    got = [(s[0], s[1]) for s in T.spans(text, T.span_pattern())]
    assert got == [("general", "ab"), ("space", " "), ("mn", f"{WORD}\u202f{WORD}"), ("general", "᠂"), ("space", " \u202f"), ("general", "x"), ("special", "<bos>"), ("mn", WORD), ("general", "<nope>")]
    assert "".join(s[1] for s in T.spans(text, T.span_pattern())) == text
    assert T.spans(None, T.span_pattern()) == []


def test_byte_fallback_and_stream():
    vocabulary = {t: i for i, t in enumerate([*byte_tokens(), "a", "b", "<unk>"])}
    names = {i: t for t, i in vocabulary.items()}
    text = "abéa\U0001f600中"
    ids = T.encode_with_fallback(text, vocabulary, vocabulary["<unk>"])
    decode = lambda x: T.decode_with_fallback(x, names)
    assert decode(ids) == text
    pieces = list(T.decode_stream(ids, decode))
    assert "".join(pieces) == text and "�" not in "".join(pieces)
    broken = ids[:-1]
    assert "".join(T.decode_stream(broken, decode)) == decode(broken)


def test_columns(spark):
    d = spark.createDataFrame([(1, "\ue240"), (2, f"\ue240{WORD}"), (3, f"{WORD}\u180b\u202f\u200b"), (4, "x")], "k long, text string")
    assert [r.e for r in d.orderBy("k").select(T.legacy_encoding(F.col("text")).alias("e")).collect()] == ["menksoft", "mixed", "unicode", "unicode"]
    three = d.where("k = 3").select(T.standard_unicode(F.col("text")).alias("s"), T.nominal_unicode(F.col("text")).alias("n")).first()
    assert (three.s, three.n) == (f"{WORD}\u180b\u180e", f"{WORD}\u180e")
    assert d.where("k = 3").select(T.segment(F.col("text")).alias("s")).first().s[0].lang == "mn"
    counts = {(r.left, r.right): r.n for r in T.pair_counts(T.word_counts(spark.createDataFrame([("aab aab b",)], "text string"))).collect()}
    assert counts == {("a", "a"): 2, ("a", "b"): 2}
    assert [r.t for r in spark.createDataFrame([("a1",), ("?",)], "p string").select(T.track(F.col("p")).alias("t")).collect()] == ["general", "general_punct"]


def test_vocabulary_and_ocr_rows(spark):
    v = lambda *t: spark.createDataFrame([(x, i) for i, x in enumerate(t)], "token string, local_id long")
    special = spark.createDataFrame([("<pad>", 0)], "token string, id int")
    got = {r.token: r.id for r in T.vocabulary_union(v("a", "<pad>", "b"), v("b", "c"), special, (10, 12), (20, 25)).collect()}
    assert got == {"<pad>": 0, "a": 10, "b": 11, "c": 20}
    with pytest.raises(Exception, match="overflows"):
        T.vocabulary_union(v("a", "b", "c"), v("d"), special, (10, 12), (20, 25)).collect()
    rows = spark.createDataFrame([([7], [1, 2]), ([], [])], "instruction array<int>, target array<int>")
    built = T.ocr_rows(rows, 2, 90, 91, 92, 93, 94)
    row = built.first()
    assert row.ids == [90, 91, 92, 92, 93, 7, 1, 2, 94] and row.labels == [-100] * 6 + [1, 2, 94]
    back = T.split_ocr_rows(built.drop("target"), 94).first()
    assert (back.prompt, back.target) == ([90, 91, 92, 92, 93, 7], [1, 2])
    with pytest.raises(ValueError):
        T.ocr_rows(rows, 0, 90, 91, 92, 93, 94)
