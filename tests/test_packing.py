import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lakecorpus.operators import packing as P
from lakecorpus.operators.training_rows import IGNORE
from pyspark.sql import functions as F


def plain(rows, limit, joint=0, most=None):
    """(pack, place) of (size, alone) rows, one after the other."""
    out, pack, used, count, closed = [], -1, 0, 0, True
    for size, alone in rows:
        full = closed or alone or used + joint + size > limit or (most and count >= most)
        if full:
            pack, used, count = pack + 1, size, 0
        else:
            used += joint + size
        out.append((pack, count))
        count += 1
        closed = bool(alone)
    return out


def by_blocks(rows, config):
    """The same by the functions of blocks, without the engine."""
    import pyarrow as pa

    blocks = [rows[k : k + config.block] for k in range(0, len(rows), config.block)]
    made = [P.Block(P.np.array([s for s, _ in b]), P.np.array([a for _, a in b], dtype=bool), config) for b in blocks]
    batch = pa.RecordBatch.from_pylist([{"block": k, **b.summary()} for k, b in enumerate(made)])
    (entered,) = P._enter(iter([batch]), config)
    out = []
    for b, e in zip(made, entered.to_pylist(), strict=True):
        starts = b.starts(b.first_new(e["used"], e["count"]))
        pack, place = e["pack"], e["count"]
        for s in starts:
            pack, place = (pack + 1, 0) if s else (pack, place)
            out.append((pack, place))
            place += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([False, False, False, True])), min_size=1, max_size=40), st.integers(1, 20), st.integers(0, 2), st.sampled_from([None, 1, 2, 5]), st.integers(1, 9))
def test_blocks_compose_to_one_order(rows, limit, joint, most, block):
    assert by_blocks(rows, P.PackConfig(limit, joint, most, block)) == plain(rows, limit, joint, most)


@pytest.mark.parametrize("joint,most,block", [(0, None, 1 << 20), (1, None, 7), (1, 4, 50)])
def test_whole_table(spark, joint, most, block):
    pick = random.Random(2)
    rows = [(k, pick.choice([1, 3, 10, 40, 120]), pick.choice([None, False, False, False, True])) for k in range(3000)]
    df = spark.createDataFrame(pick.sample(rows, len(rows)), "position long, size int, alone boolean").repartition(6)
    got = P.next_fit(df, P.PackConfig(100, joint, most, block)).orderBy("position").collect()
    assert [(r.pack, r.place) for r in got] == plain([(s, a) for _, s, a in rows], 100, joint, most)
    assert P.next_fit(df.limit(0), P.PackConfig(100)).count() == 0
    with pytest.raises(ValueError):
        P.next_fit(df, P.PackConfig(0))


TOKENS = "position long, ids array<int>, labels array<int>, word_pos array<int>, morph_depth array<int>, offsets array<struct<start:int,end:int>>, image_spans array<struct<start:int,end:int>>, video_spans array<struct<start:int,end:int>>, images array<string>, ocr_labels array<array<int>>"


def sample(position, n, words=None, images=(), payload=(), labels=None):
    ids = [1000 * position + k for k in range(n)]
    return (position, ids, list(ids), words if words is not None else [k // 2 for k in range(n)], [k % 2 for k in range(n)], [(k, k + 1) for k in range(n)], list(images), [], list(payload), list(labels or [[1] for _ in payload]))


def test_packs_with_media(spark):
    rows = [sample(0, 5), sample(1, 6), sample(2, 4), sample(3, 6, images=[(1, 4)], payload=["a.png"], labels=[[1, 2, 3]]), sample(4, 3), sample(5, 0), sample(6, 10, images=[(1, 4), (6, 9)], payload=["a.png", "b.png"], labels=[[1], [2]]), sample(7, 30), sample(8, 2)]
    df = spark.createDataFrame(rows, TOKENS)
    out = {r.pack: r for r in P.pack_samples(df, 12, 99, pad_id=7, position="position").collect()}
    lone = lambda r: [x for x in r.ids if x != 7]
    ids = {r[0]: r[1] for r in rows}
    assert [lone(out[k]) for k in sorted(out)] == [ids[0] + [99] + ids[1], ids[2], ids[3], ids[4], ids[6], ids[7][:12], ids[8]]
    assert [out[k].num_samples for k in sorted(out)] == [2, 1, 1, 1, 1, 1, 1]
    first = out[0]
    assert first.word_pos == [0, 0, 1, 1, 2, 3, 4, 4, 5, 5, 6, 6] and first.labels == first.ids and first.morph_depth[5] == 0
    assert tuple(first.offsets[5]) == (-1, -1) and tuple(first.offsets[6]) == (0, 1)
    assert out[2].images == ["a.png"] and out[2].ocr_labels == [[1, 2, 3]] and out[2].alone and [tuple(s) for s in out[2].image_spans] == [(1, 4)]
    assert out[0].images == [] and not out[0].alone
    assert out[4].images == ["a.png", "b.png"]
    for r in out.values():
        assert len(r.ids) == len(r.labels) == len(r.attention_mask) == len(r.word_pos) == len(r.morph_depth) == len(r.offsets) == 12
        n = len(lone(r))
        assert r.attention_mask == [1] * n + [0] * (12 - n) and r.labels[n:] == [IGNORE] * (12 - n) and all(tuple(o) == (-1, -1) for o in r.offsets[n:])


def test_trim_drops_media_whose_span_falls_off(spark):
    row = sample(0, 10, images=[(1, 4), (6, 9)], payload=["a.png", "b.png"], labels=[[1], [2]])
    (got,) = P.trim(spark.createDataFrame([row], TOKENS), 8).collect()
    assert len(got.ids) == 6 and [tuple(s) for s in got.image_spans] == [(1, 4)] and got.images == ["a.png"] and got.ocr_labels == [[1]] and got.alone
    (got,) = P.trim(spark.createDataFrame([row], TOKENS), 3).collect()
    assert len(got.ids) == 1 and got.images == [] and got.alone
    # a row of which nothing is left has no pack
    gone = sample(1, 10, images=[(0, 9)], payload=["a.png"])
    assert P.pack_samples(spark.createDataFrame([gone], TOKENS), 8, 99, position="position").count() == 0


def test_words_go_on_over_three_texts_and_nulls_pass(spark):
    rows = [(k, [k], [k], [0]) for k in range(3)] + [(3, None, None, None), (4, [4], [4], [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, labels array<int>, word_pos array<int>").withColumns({n: F.lit(n) for n in ("pack", "place", "alone", "_cut", "size")})
    (got,) = P.pack_samples(df, 100, 9).collect()
    assert got.ids == [0, 9, 1, 9, 2, 9, 4] and got.word_pos == [0, 1, 2, 3, 4, 5] and got.num_samples == 4
    assert P.pack_samples(df.limit(0), 100, 9).count() == 0
