import re
import pytest
from lakecorpus.functions import hashing as H
from lakecorpus.functions import markup
from lakecorpus.functions import metrics as M
from lakecorpus.functions import textnorm as N
from lakecorpus.operators import boxes, quality
from pyspark.sql import functions as F


LINE = "the quick brown fox jumps over the lazy dog "


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("x")).first().x


def test_normalizers(spark):
    assert one(spark, N.squash, " a\u3000 b\n") == "a b"
    assert one(spark, N.normalize_web, "ＡＢＣ１２３") == "ABC123"
    assert one(spark, N.normalize_web, "a   b\r\nc \n\n\n d\u200b") == "a b\nc\n\nd"
    assert one(spark, N.normalize_web, None) == ""
    assert one(spark, N.fold_control, "\u1820\u180b\u202f\u1820\ufeff") == "\u1820 \u1820"
    assert one(spark, N.fold_answer, "  Hello \n World ") == "hello world"
    assert one(spark, N.normalize_document, "a\xa0b\x01\n\n\n\nc") == "a b\n\nc"
    assert one(spark, N.normalize_key, "a\n\n b") == "a b"
    assert one(spark, N.normalize_line, "\ufeff None ") == ""
    assert one(spark, N.normalize_json, '{"role": "user", "content": ["a", " ", "b\\n\\nc"]}') == "user\na\nb\nc"
    assert one(spark, N.normalize_running_line, "| Page 12 # see http://x.y/z me@x.org ***** end page 3") == "see * end"
    assert one(spark, N.utf8_hex, "é!") == ["c3", "a9", "21"]


def test_ratios(spark):
    assert one(spark, lambda c: M.script_ratio(c, "mongolian"), "ᠠᠡabc") == 2 / 5
    assert one(spark, lambda c: M.script_ratio(c, "zh"), "中文abc") == 2 / 5
    assert one(spark, lambda c: M.script_ratio(c, "zh"), " \n") == 0
    assert one(spark, M.digit_ratio, "中12") == 2 / 3
    assert one(spark, M.repeated_line_fraction, "a\na\nb") == 1 / 3
    assert one(spark, lambda c: M.repeated_line_fraction(c, 4), "a\na\nb") == 0
    assert one(spark, lambda c: M.ngram_shares(c, (2,), (2,))["repeated_2"], "abab") == 1 / 3
    assert one(spark, lambda c: M.ngram_shares(c, (2,), (2,))["top_2"], "aaaaaa") > 0.8
    assert one(spark, M.token_count, "中文 abc") == 3
    assert one(spark, M.mean_word_length, "one two three") is None
    assert one(spark, lambda c: M.script_letter_ratio(c, "cyrillic"), "аб12x") == 2 / 3
    with pytest.raises(ValueError):
        M.script_ratio(F.lit("a"), "runic")
    assert M.graphemes("\u1820\u180b\u180e\u202f\u0301") == ["\u1820\u180b", "\u180e", "\u202f", "\u0301"]


@pytest.mark.parametrize(
    ("text", "config", "reason"),
    [
        ("short", {}, "too_short"),
        (None, {}, "too_short"),
        ("# # # # … … • • | |", {"min_chars": 1}, "symbol_spam"),
        (" ".join(["abcdefghijklmnopqrst"] * 10), {"max_word_length": 10.0, "max_repeated_lines": 1.0}, "word_len"),
        ("今天天气很好，我们一起去公园散步吧。" * 5, {}, ""),
        ("a line of words\n" * 8, {}, "repeated_lines"),
        ("plain words make up this text, and All Rights Reserved stands in it", {}, "boilerplate"),
        ("latin letters only in this text of some length", {"script": "zh"}, "script_impurity"),
    ],
)
def test_general_gate(spark, text, config, reason):
    assert one(spark, lambda c: quality.quality_reason(c, quality.QualityConfig(**config)), text) == reason


def test_web_gate(spark):
    good = "今天天气很好。我们一起去公园散步吧！"
    varied = "".join(chr(0x4E00 + (i * 37) % 5000) + ("。" if i % 17 == 0 else "") for i in range(400))
    rows = [(1, varied), (2, "太短"), (3, good * 40), (4, "latin only " * 40), (5, varied + "\n版权所有"), (6, varied + "代办证件 微信：abc12345")]
    got = {r.doc_id: (r.reason, r.clean_text) for r in quality.web_gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "", 2: "too_short", 3: "repetitive", 4: "low_script", 5: "", 6: "spam"} or got[3][0] == "ngram_spam"
    assert got[5][1] == varied and got[2][1] is None


def test_other_gates(spark):
    mongolian = "ᠮᠣᠩᠭᠣᠯ ᠬᠡᠯᠡ " * 12
    assert one(spark, quality.running_text_reason, mongolian) == ""
    assert one(spark, quality.running_text_reason, mongolian + "\ue000") == "pua"
    assert one(spark, quality.running_text_reason, mongolian + "ж") == "cyrillic_noise"
    bucket = quality.BUCKETS["zh_classical"]
    assert one(spark, lambda c: quality.bucket_reason(c, bucket), "学而时习之，不亦说乎？有朋自远方来，不亦乐乎？") == ""
    assert one(spark, lambda c: quality.bucket_reason(c, bucket), "�" * 30) == "decode_replacement"
    assert one(spark, lambda c: quality.bucket_reason(c, bucket), "Access denied " * 3) == "error_page"


def test_markup(spark):
    text = "# Title\n- *item* [link](http://a.b)\n> `code`\n![x](y)\n```\ngone\n```\nend"
    assert one(spark, markup.markdown_to_text, text) == "Title\n*item* link\ncode\n\nend"
    page = "<?xml version='1.0'?><html><title> A &amp; B </title><nav>menu</nav>tail<div class=x>one</div><div class=x><p>longer one</p></div><script>no</script></html>"
    assert markup.html_parts(page, (".x",)) == ("longer one", "A & B")
    assert markup.html_parts(page)[0] == "tail\none\nlonger one"
    assert markup.html_parts(None) == ("", "")
    assert one(spark, markup.html_title, "<title>\n A  b</title>") == "A b"
    assert one(spark, markup.slugify, "A b/C!") == "a-b-c"
    assert one(spark, markup.strip_ruby_markup, "頭\n" + "-" * 30 + "\n記号\n" + "-" * 30 + "\n｜漢字《かんじ》［＃注］本文\n底本：x") == "漢字本文"


def test_keys(spark):
    assert one(spark, H.exact_key, " a  b ") == one(spark, H.exact_key, "a b")
    assert one(spark, lambda c: H.shingles(M.tokens(c)), "a b") == ["a b"]
    assert one(spark, lambda c: H.shingles(M.tokens(c)), "") == []
    assert one(spark, lambda c: H.shingles(M.tokens(c)), "a b c d e") == ["a b c d", "b c d e"]
    assert one(spark, H.simhash, "") == 0
    near = [one(spark, H.simhash, t) for t in (LINE * 30, LINE * 30 + "small appendix")]
    assert bin((near[0] ^ near[1]) & (2**64 - 1)).count("1") <= 3
    assert [b.value for b in one(spark, lambda c: H.bands(F.lit(0x0001000200030004).cast("long")), "x")] == [4, 3, 2, 1]


def test_boxes(spark):
    f = lambda *v: one(spark, lambda a, b: boxes.box_token(F.lit(v[0]), F.lit(v[1]), F.lit(v[2]), F.lit(v[3]), a, b), 100, 200)
    assert f(0.0, 0.0, 50.0, 200.0) == "<bbox_000_000_500_999>"
    assert f(60.0, 0.0, 50.0, 200.0) is None
    box = one(spark, lambda c: boxes.box_of(c, F.lit(999), F.lit(999)), "<bbox_000_010_500_999>")
    assert [round(v, 6) for v in (box.x0, box.y0, box.x1, box.y1)] == [0, 10, 500, 999]
    assert one(spark, lambda c: boxes.expand_placeholders(c, F.array(F.lit(2), F.lit(1))), "<image> a <image>") == "<image_start><image_patch><image_patch><image_end> a <image_start><image_patch><image_end>"
    assert one(spark, lambda a, b: boxes.patches(a, b), 280, 57) == 30


def test_plain_texts_are_spared_the_full_classes(spark):
    """tokens, the web normalizer and its filters look once whether a text needs the dear patterns at all; odd characters give what Python gives."""
    import random

    rng = random.Random(8)
    letters = [*"ab\u00e9 \n\t\x1c\x85\xa0\xad\u1680\u180e\u2028\u200b\u3000\u3041\u4e2d\u1820\U0001f600\u2013", "\r\n", "  "]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(500)]
    unspaced = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    for r in spark.createDataFrame([(t,) for t in odd], "t string").select("t", M.tokens(F.col("t")).alias("tokens"), M.compact(F.col("t")).alias("compact"), N.squash(F.col("t")).alias("squash")).collect():
        assert r.tokens == re.findall(f"[{unspaced}]|[^\\s{unspaced}]+", r.t)
        assert r.compact == "".join(r.t.split()) and r.squash == " ".join(r.t.split())
    d = spark.createDataFrame([("a",)], "t string")
    for c in (M.tokens(F.col("t")), M.compact(F.col("t")), N.tidy_web(F.col("t"))):
        assert N.FOREIGN in d.select(c)._jdf.queryExecution().analyzed().toString()
    for c in (quality.is_spam(F.col("t")), quality.strip_furniture_lines(F.col("t"))):
        assert r"[\x{4e00}-\x{9fff}]" in d.select(c)._jdf.queryExecution().analyzed().toString()
