import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lakecorpus.llm import importance_resampling as ir
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crcs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, buckets=10_000, least=20, percent=5, seed=42):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for c in crcs(text)[0]:
            s[c % buckets] += 1
    for text in target:
        for c in crcs(text)[0]:
            t[c % buckets] += 1
    S, T = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        found, n = crcs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


pieces = st.sampled_from(["a", "B", "Zz", "9", " ", "\n", "-", "é", "字", "\x00", "😀", "{", "`", "@", "x" * 63, "x" * 64, "Y" * 65, "ß" * 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(pieces, max_size=14).map("".join)), max_size=6), st.sampled_from([1, 3, 64, 1 << 18]), st.integers(0, 2))
def test_runs_equal_those_of_each_text(texts, block, skip):
    got = [[] for _ in texts[skip:]]

    def each(docs, crc, valid):
        for k in range(ir.RUN):
            for d, c, v in zip(docs, crc[k], valid[k], strict=True):
                if v:
                    got[d].append(int(c))

    before, ir.BLOCK = ir.BLOCK, block
    try:
        ir.runs(pa.array(texts, type=pa.string())[skip:], each)
    finally:
        ir.BLOCK = before
    assert [sorted(g) for g in got] == [sorted(crcs(t)[0]) for t in texts[skip:]]


def test_equals_brute_force(spark, docs_of, odd_docs):
    pick = random.Random(5)
    words = [f"w{pick.randrange(60)}" for _ in range(400)] + ["ÉCOLE", "Straße", "字"]
    rows = [(k, " ".join(pick.choices(words, k=pick.choice([0, 3, 19, 20, 40, 80])))) for k in range(100, 300)]
    rows += [(100, rows[0][1]), (None, "w1 w2 " * 15), (7, None), (8, "a" * 3_000_000), (9, "b c. " * 200_000), (300, "w1 W2 w3-w4 " * 30), (301, "w1 W2 w3-w4 " * 30)]
    target = ["w1 w2 w3 w4", None, "", "w5 w1"]
    docs = docs_of([(*r, None, None) for r in rows])
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in ir.resample(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, target), key=key)
    some = ir.ResamplingConfig(buckets=97, least_words=3, percent=50, seed=1)
    got = [tuple(r) for r in ir.resample(docs, bench, some).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, target, 97, 3, 50, 1), key=key)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in ir.resample(odd_docs, bench.limit(0)).collect()]
    assert sorted(got, key=key) == sorted(brute(odd, []), key=key)


def test_clashing_columns_and_empty_tables(spark, docs_of, clashing):
    docs = clashing(docs_of(["a b c " * 10, "d e f " * 10]))
    clash = docs.withColumns({n: F.lit(n) for n in ("bucket", "s", "t", "rank", "_able", "_at", "_part", "_text")})
    out = ir.resample(clash, spark.createDataFrame([("a",)], "text string"), keep=tuple(c for c in docs.columns if "`" not in c and "." not in c))
    assert out.count() == 2 and all(r["h"] == "h" and r["_pos"] == "_pos" for r in out.collect())
    assert ir.resample(docs.limit(0), docs.select("text")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_query(spark, sf):
    from lakecorpus.llm.queries import queries

    at = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries()["op13_importance_resampling"](spark, at).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, target), key=key)
