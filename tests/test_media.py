import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lakecorpus.operators import media as M
from lakecorpus.operators import pooling as P
from pyspark.sql import functions as F


def plain(text, images, videos):
    """Expanded text, places (start, end), and for each place in the expanded text the one in the text: a list as long as it, character by character."""
    out, back, i, n = [], [0], 0, {"image": 0, "video": 0}
    for m in [*re.finditer("<(image|video)>", text), None]:
        end = m.start() if m else len(text)
        out.append(text[i:end])
        back += range(i + 1, end + 1)
        if m:
            k = m[1]
            patches = (images if k == "image" else videos)[n[k]]
            n[k] += 1
            block = f"<{k}_start>" + f"<{k}_patch>" * (1 if patches is None else patches) + f"<{k}_end>"
            out.append(block)
            back += [m.end()] * len(block)
            i = m.end()
    return "".join(out), back


ROWS = [(1, "a <image> b<video>c", [2], [1]), (2, "no media", None, []), (3, "<image><image>", [1, None], None), (4, "字<video>é", [], [3]), (5, "", [], []), (6, "x <images> <image", [], []), (7, "long " * 3000 + "<image>", [5], [])]
SCHEMA = "doc_id long, text string, image_patches array<int>, video_patches array<int>"


def test_offsets_go_back_to_the_text(spark):
    texts = M.expand(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.doc_id: r for r in texts.collect()}
    places = texts.select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.length("expanded"), F.lit(400)))).alias("at"), "edits").select("doc_id", "at", M.source_offset(F.col("at"), F.col("edits")).alias("back")).collect()
    for doc, text, images, videos in ROWS:
        expanded, back = plain(text, images or [], videos or [])
        assert got[doc].expanded == expanded
        assert [r.back for r in sorted((r for r in places if r.doc_id == doc), key=lambda r: r.at)] == back[:401]
    assert spark.range(1).select(M.source_offset(F.lit(-1), F.array().cast(M.EDIT))).first()[0] == -1


def test_tokens_and_spans(spark):
    texts = M.expand(spark.createDataFrame(ROWS, SCHEMA))
    annotated = M.annotate(M.tokenized(texts), texts)
    text = {r[0]: r[1] for r in ROWS}
    for r in annotated.collect():
        if r.image_index is not None or r.video_index is not None:
            assert text[r.doc_id][r.start : r.end] in ("<image>", "<video>")
        else:
            assert text[r.doc_id][r.start : r.end] == r.token
    spans = {(r.doc_id, r.kind, r["index"]): (r.start, r.end) for r in M.media_spans(annotated, texts).collect()}
    assert spans == {(1, "image", 0): (1, 5), (1, "video", 0): (6, 9), (3, "image", 0): (0, 3), (3, "image", 1): (3, 6), (4, "video", 0): (1, 6), (7, "image", 0): (3000, 3007)}
    first = {(r.token, r.start, r.end, r.image_index) for r in annotated.where("doc_id = 3").collect()}
    assert ("<image_patch>", 0, 7, 0) in first and ("<image_patch>", 7, 14, 1) in first
    lost = annotated.where("token <> '<image_patch>' OR doc_id <> 1")
    with pytest.raises(Exception, match="don't match"):
        M.media_spans(lost, texts).collect()


@pytest.mark.parametrize("row", [(1, "<image>", [], []), (1, "a", [1], []), (1, "<video><video>", [], [1])])
def test_wrong_numbers_of_media_raise(spark, row):
    with pytest.raises(Exception, match="differ in number"):
        M.expand(spark.createDataFrame([row], SCHEMA)).select("expanded").collect()


def test_null_texts_and_clashing_names(spark):
    d = spark.createDataFrame([(1, None, None, None)], SCHEMA).withColumns({n: F.lit(n) for n in ("start", "end", "kind")})
    (r,) = M.expand(d).collect()
    assert r.expanded is None and r.kind == "kind"
    assert M.expand(d.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "<image>", "<video>", "字", "<", "image>"]), max_size=8).map("".join))
def test_plain_places_are_within_the_text(text):
    images, videos = [2] * text.count("<image>"), [1] * text.count("<video>")
    expanded, back = plain(text, images, videos)
    assert len(back) == len(expanded) + 1 and back[-1] == len(text) and back == sorted(back)


def test_mean_pool(spark):
    pick = random.Random(0)
    rows = [(pick.choice([1, 2, None]), pick.choice([0, 1]), [float(pick.randint(-9, 9)) for _ in range(4)], pick.choice([True, True, False, None])) for _ in range(300)]
    rows += [(5, 0, [1.0, 2.0], False), (6, 0, None, True), (7, 0, [2.0, None], True), (7, 0, [4.0, 6.0, 8.0], True), (8, 0, [], True)]
    df = spark.createDataFrame(rows, "a long, b long, vector array<float>, used boolean")
    got = {(r.a, r.b): (r.n, r.vector) for r in P.mean_pool(df, "a", "b", mask="used").collect()}
    for key in {(r[0], r[1]) for r in rows if r[0] in (1, 2, None)}:
        mine = [v for a, b, v, u in rows if (a, b) == key and u]
        assert got[key] == (len(mine), [sum(c) / len(mine) for c in zip(*mine, strict=True)])
    assert got[5, 0] == (0, [0.0, 0.0]) and got[6, 0] == (0, []) and got[7, 0] == (2, [3.0, 3.0, 4.0]) and got[8, 0] == (1, [])
    back = P.scatter_back(df, P.mean_pool(df, "a", "b", mask="used"), "a", "b")
    assert back.count() == len(rows) and all(r.pooled == got[r.a, r.b][1] for r in back.collect())
    assert P.mean_pool(df.limit(0), "a").count() == 0
    with pytest.raises(ValueError):
        P.mean_pool(df)
    assert [r[0] for r in spark.range(-2, 6).select(P.clamped(F.col("id"), 3)).collect()] == [0, 0, 0, 1, 2, 2, 2, 2]
