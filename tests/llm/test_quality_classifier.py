import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lakecorpus.llm import quality_classifier as qc
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """The features of one text, one after the other."""
    t = text or ""
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
    n = lambda which: sum(t.count(c) for c in which)
    capitals = sum(c.isupper() and len(c) == 1 for c in t)
    lines = t.split("\n")
    stutters = sum(a == b for a, b in zip(w, w[1:]))
    c, k = len(t) + 20, len(w) + 5
    shouted = max(capitals - n(".!?") - n("\n") - 1, 0)
    return [math.sqrt(n("#*$%&|<>~^=_@`{}[]\\+") / c), math.sqrt(n("!?") / c), math.sqrt(shouted / c), math.sqrt(n("0123456789") / c), n(".!?") / k, n(",;:") / k, math.sqrt(stutters / k), math.sqrt((len(lines) - len(set(lines))) / (n("\n") + 3)), min(len(t) / k, 30), math.log1p(len(w)), 1 / (1 + len(w)), n("\n") / c]


pieces = st.sampled_from(["a", "B", "Ä", "ж", "Ж", "字", "😀", " ", "\n", ".", "!", ",", "7", "#", "so so ", "x\nx\n", "\x00", "And And"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(pieces, max_size=12).map("".join)), min_size=1, max_size=6))
def test_features_equal_those_of_each_text(texts):
    got = qc._features(pa.array(texts, type=pa.string()))
    assert got.shape == (len(texts), qc.N_FEATURES)
    np.testing.assert_allclose(got, [plain(t) for t in texts], atol=1e-12)


@given(st.integers(0, 10_000))
def test_sums_of_a_block_equal_those_of_its_pairs(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(0, 30)), 4
    x, good = rng.normal(size=(n, d)), rng.random(n) < 0.6
    model = qc.Ranking(rng.normal(size=d), np.full(d, 1.5), rng.normal(size=d))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(good)], names=["features", "good"])
    (out,) = qc._step_of(iter([batch]), model, 8)
    got = np.array(out.column("sums")[0].as_py())
    pairs, gradient, curvature = 0, np.zeros(d), np.zeros((d, d))
    z = (x - model.mean) / model.scale
    for k in range(0, n, 8):
        for i in range(k, min(k + 8, n)):
            for j in range(k, min(k + 8, n)):
                if good[i] and not good[j]:
                    diff = z[i] - z[j]
                    p = 1 / (1 + math.exp(diff @ model.weights))
                    pairs, gradient, curvature = pairs + 1, gradient - p * diff, curvature + p * (1 - p) * np.outer(diff, diff)
    np.testing.assert_allclose(got, np.r_[pairs, gradient, curvature.ravel()], atol=1e-9)


def test_held_out_documents(spark):
    from lakecorpus.llm.queries import queries

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = queries()["op11_quality_classifier"](spark, at).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(r.score, r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99 and np.mean([p == q for _, p, q in held]) > 0.97


def labelled(docs_of, spark):
    docs = docs_of([(k, f"A plain line about thing {k}, and more of it." if k % 3 else "BUY### NOW$$$ !!! " * 3) for k in range(300)])
    return docs, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")


def test_odd_documents(spark, docs_of, odd_docs, clashing):
    docs, labels = labelled(docs_of, spark)
    odd_labels = labels.union(spark.createDataFrame([(1, None), (None, 1), (2, 1), (999, 0)], "doc_id long, quality int"))
    model = qc.train(qc.sample_labelled(docs.union(docs.limit(5)), odd_labels))
    out = qc.classify(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[4]) == 1 and by[1] == by[2]  # repeated rows alike; null is empty
    texts = docs_of([None, "", "word " * 1_000_000, "x" * 5_000_000, "Fine words, in a row.", "BUY### NOW$$$ !!!"])
    got = {r.doc_id: r for r in qc.classify(texts, model).collect()}
    assert got[0].score == got[1].score and got[4].predicted == 1 and got[5].predicted == 0
    both = clashing(docs.limit(20)).withColumns({n: F.lit(n) for n in ("features", "latent", "_kept", "_score", "_text")})
    assert clashing.unharmed(qc.classify(both, model, keep=tuple(f"`{c.replace('`', '``')}`" for c in both.columns)))
    assert qc.classify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("only", [0, 1, None])
def test_without_both_kinds(spark, docs_of, only):
    docs, labels = labelled(docs_of, spark)
    model = qc.train(qc.sample_labelled(docs, labels.where(F.col("quality") == only) if only is not None else labels.limit(0)))
    assert model is None and {r.score for r in qc.classify(docs, model).collect()} == {0.5}


def test_sample_is_bounded_and_ids_cannot_leak(spark, docs_of):
    docs, labels = labelled(docs_of, spark)
    few = qc.sample_labelled(docs, labels, qc.RankingConfig(most_labelled=100))
    assert 50 < few.count() < 150
    used = {r.key for r in qc.sample_labelled(docs, labels).collect()}
    assert used == {k for k in range(300) if zlib.crc32(str(k).encode()) % 5}
    model = qc.train(few)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("xx"))
    a, b = (sorted(r.score for r in qc.classify(d, model).collect()) for d in (docs, moved))
    assert a == b


def test_all_labelled_rows_are_learned_from(spark):
    assert qc.RankingConfig().most_labelled is None
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some words.").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert qc.sample_labelled(docs, labels).count() == labels.where(~qc.held_out(F.col("doc_id"))).count() > 20_000


def test_quantile_is_exact(spark, monkeypatch):
    monkeypatch.setattr(qc, "FEW", 20)
    monkeypatch.setattr(qc, "BINS", 8)
    values = spark.range(3_000).select((F.pow(F.col("id") % 997, 3) / 7).alias("latent"))
    for level in (0.0, 0.1234, 0.5, 1.0):
        assert qc.quantile(values, level) == pytest.approx(values.agg(F.percentile("latent", F.lit(level))).first()[0], rel=1e-12)
    assert qc.quantile(values.select(F.lit(2.0).alias("latent")), 0.3) == 2.0
