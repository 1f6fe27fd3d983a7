import json

from lakecorpus.operators.quality import BucketConfig, RunningTextConfig
from lakecorpus.plans import jobs

LINE = "the quick brown fox jumps over the lazy dog "


def write(path, texts):
    path.write_text("\n".join(json.dumps({"text": t}) for t in texts) + "\n")
    return str(path)


def test_clean_files(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [LINE * 2, "short", " " + LINE * 2])
    b = write(tmp_path / "b.jsonl", [LINE * 2, "a different text that is also long enough"])
    counts = {r.reason: r.n_docs for r in jobs.clean_files(spark, [a, b], str(tmp_path / "out"), near=False).collect()}
    assert counts == {"": 2, "too_short": 1, "duplicate": 2}
    c = write(tmp_path / "c.jsonl", [LINE * 2] * 3)  # equal rows of one file count each
    counts = {r.reason: r.n_docs for r in jobs.clean_files(spark, [c], str(tmp_path / "out2"), near=False).collect()}
    assert counts == {"": 1, "duplicate": 2}
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_buckets_and_running_text(spark, tmp_path):
    rows = [(1, "x", "s", LINE * 3), (2, "x", "s", LINE * 3), (3, "x", "t", "short"), (4, "nope", "t", LINE)]
    d = spark.createDataFrame(rows, "doc_id long, bucket string, source string, text string")
    out = jobs.clean_buckets(d, str(tmp_path / "b"), {"x": BucketConfig("en", "prose")}).collect()
    assert {(r.bucket, r.reason): r.n_docs for r in out if r.bucket} == {("x", ""): 2, ("x", "too_short"): 1, ("nope", "unknown_bucket"): 1}
    assert spark.read.json(str(tmp_path / "b")).count() == 1
    text = "ᠮᠣᠩᠭᠣᠯ ᠬᠡᠯᠡ " * 30
    chunks = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    counts = jobs.clean_running_text(chunks, str(tmp_path / "r"), 150, config=RunningTextConfig(min_chars=20)).collect()
    kept = spark.read.json(str(tmp_path / "r"))
    assert {r.reason for r in counts} == {""} and 0 < kept.count() <= counts[0].n_docs / 2


def test_mixture_seed_and_rows(spark, tmp_path):
    a, b = write(tmp_path / "a.jsonl", [f"aaaa {i} " * 5 for i in range(20)]), write(tmp_path / "b.jsonl", [f"bbbb {i} " * 5 for i in range(200)])
    sources = [jobs.MixSource(a, 0.6), jobs.MixSource(b, 0.4)]
    plan = {r.source: r.repeat_factor for r in jobs.build_mixture(spark, sources, None).collect()}
    assert plan["0"] == 4.0 and plan["1"] < 1
    assert {r.source: r.emitted_docs for r in jobs.build_mixture(spark, sources, str(tmp_path / "mix")).collect()}["0"] == 80
    assert jobs.build_mixture(spark, sources, str(tmp_path / "mix"), skip_if_fresh=True) is None
    write(tmp_path / "a.jsonl", [f"aaaa {i} " * 5 for i in range(19)])
    assert {r.source: r.emitted_docs for r in jobs.build_mixture(spark, sources, str(tmp_path / "mix"), skip_if_fresh=True).collect()}["0"] == 76
    report = {r.source: r.emitted_docs for r in jobs.build_mixture(spark, sources, str(tmp_path / "mix2")).collect()}
    (tmp_path / "mix2").rename(tmp_path / "mix3")
    assert report["0"] == 76 and spark.read.json(str(tmp_path / "mix3")).count() == sum(report.values())
    records = [(i, "", "关于数学的论文" + str(i) * 90) for i in range(5)] + [(9, "物理", "x" * 90), (10, "", "y" * 90)]
    got = jobs.extract_seed(spark.createDataFrame(records, "doc_id long, meta string, text string"), str(tmp_path / "seed"), per_domain=3).collect()
    assert {r.domain: r["count"] for r in got} == {"math": 3, "physics": 1}
    docs = spark.createDataFrame([(i, "text " * 10) for i in range(40)] + [(99, None)], "doc_id long, text string")
    for pack, shards in ((True, None), (False, 200)):
        gate = jobs.build_training_rows(docs, str(tmp_path / f"rows{pack}"), 128, shards, pack=pack).first()
        assert gate.passed and gate.max_length <= 128
    assert spark.read.parquet(str(tmp_path / "rowsFalse")).groupBy("shard").count().count() > 5
