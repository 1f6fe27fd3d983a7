import hashlib
import json
import random
import re
import zipfile

import pytest
from lakecorpus.functions import hashing as H
from lakecorpus.functions import metrics as M
from lakecorpus.operators import chunking, dedup, mixture
from lakecorpus.operators import conversations as C
from lakecorpus.operators import evaluation as E
from lakecorpus.operators import training_rows as T
from lakecorpus.plans.clean import clean_corpus, kept
from lakecorpus.sources import readers, sinks
from lakecorpus.streaming import ingest
from pyspark.sql import functions as F

LINE = "the quick brown fox jumps over the lazy dog "


def test_clean_from_end_to_end(spark):
    rows = [(1, LINE * 2), (2, "  " + LINE * 2), (3, "short"), (4, "another text that is long enough to pass the gate")]
    out = {r.doc_id: r.reason for r in clean_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "", 2: "duplicate", 3: "too_short", 4: ""}
    near = [(1, LINE * 30), (2, LINE * 30 + "small appendix"), (3, "other words stand in this text, which is near to none")]
    cleaned = clean_corpus(spark.createDataFrame(near, "doc_id long, text string"), near=True)
    assert sorted(r.doc_id for r in kept(cleaned).collect()) == [1, 3]


def test_greedy_follows_the_order(spark):
    rng = random.Random(4)
    for _ in range(4):
        pairs = [(a, a + rng.randint(1, 3)) for a in range(25) if rng.random() < 0.7]
        alive, gone = set(), set()
        for p in range(30):
            if any(b == p and a in alive for a, b in pairs):
                gone.add(p)
            else:
                alive.add(p)
        got = {r.dropped for r in dedup.greedy_drops(spark.createDataFrame(pairs, "earlier long, later long")).collect()}
        assert got == gone


def test_marks_of_a_text_equal_plain_loops(spark, tmp_path):
    """key, number of terms and signature come from one pass over the text; near_dedup neither shuffles nor writes texts for them."""
    rng = random.Random(21)
    letters = [*"ab\u00e9  \n\t\x1c\x85\xa0\u1680\u180e\u2028\u3000\u3041\u4e2d\uf900\U0001f600", "  ", "word ", "\u1820\u1821 "]
    texts = ["", " ", "one", "a b c", "a b c d", "a b c d e", *("".join(rng.choice(letters[: rng.choice([4, 22, 24])]) for _ in range(rng.randrange(80))) for _ in range(300))]
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(2 * H._VOTES + 7))

    def want(t):
        terms = re.findall("[\u1800-\u18af\U00011660-\U0001167f]+", t) or re.findall("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff]|[^\\s\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff]+", t)
        runs = [" ".join(terms[i : i + 4]) for i in range(max(len(terms) - 3, 1))] if terms else []
        hashes = [int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest()) for r in runs]
        sig = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return hashlib.sha1(" ".join(t.split()).encode()).hexdigest(), len(terms), sig - (1 << 64) * (sig >> 63)

    rows = [(i, t) for i, t in enumerate([*texts, long])]
    docs = spark.createDataFrame([*rows, (-1, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r.m) for r in docs.select("doc_id", H.marks(F.col("text")).alias("m")).collect()}
    assert got == {-1: (None, None, 0)} | {i: want(t) for i, t in rows}
    for r in docs.select(H.marks(F.col("text"))["exact_key"].alias("a"), H.exact_key(F.col("text")).alias("b"), H.marks(F.col("text"))["n_terms"].alias("n"), F.size(M.dedup_terms(F.col("text"))).alias("m"), "text").collect():
        assert r.a == r.b and (r.text is None or r.n == r.m)
    docs.write.parquet(f"{tmp_path}/docs")
    plan = dedup.near_dedup(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().optimizedPlan().toString()
    written = [x for x in plan.splitlines() if "LogicalRDD" in x]
    assert written and not any("text#" in x for x in written)


def test_near_pairs_share_a_band(spark):
    rows = [(1, 0), (2, 0b111), (3, 0b1111), (4, (1 << 20) | (1 << 40) | (1 << 50) | 1), (5, -1)]
    got = {(r.earlier, r.later, r.distance) for r in dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, sig long")).collect()}
    assert got == {(1, 2, 3), (2, 3, 1)}


def test_chunks():
    text = "\n\n".join(["one two three", "x" * 25, "four\nfive six seven eight nine"])
    out = list(chunking.split_text(text, 12))
    assert all(len(c) <= 12 for c in out) and "".join(out).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert list(chunking.split_text("short", 100)) == ["short"]
    assert chunking.split_line("aa bb cc", 5) == ["aa bb", "cc"]
    overlapping = list(chunking.split_text("a1 b1\nc1 d1\ne1 f1", 11, 1))
    assert overlapping == ["a1 b1", "a1 b1\n\nc1 d1"[7:] + "\ne1 f1"] or len(overlapping) >= 2


def test_chunk_columns(spark):
    d = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    assert d.select(chunking.chunk_words(F.split("text", " "), 8).alias("x")).first().x == ["one two", "three", "four"]
    rows = chunking.split_documents(d, 9).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.text) for r in rows] == [(0, "one two"), (1, "three"), (2, "four")]


def test_mixture(spark):
    rows = [(i, "m" * 40, "mn") for i in range(10)] + [(100 + i, "e" * 40, "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("mn", 0.7), ("en", 0.3)], "source string, weight double")
    planned = mixture.plan(mixture.measure(docs), weights).cache()
    factors = {r.source: r.repeat_factor for r in planned.collect()}
    assert 1 < factors["mn"] <= 4 and factors["en"] < 1
    counts = {r["source"]: r["count"] for r in mixture.emit(docs, planned).groupBy("source").count().collect()}
    assert counts["mn"] == 40 and abs(counts["en"] - 100 * factors["en"]) < 15
    draws = spark.range(20000).select(mixture.copies(F.lit(2.5), H.uniform(F.lit("s"), F.col("id").cast("string"))).alias("n"), mixture.copies(F.lit(0.3), H.uniform(F.lit("t"), F.col("id").cast("string"))).alias("m"), mixture.copies(F.lit(0.0), F.lit(0.0)).alias("z"))
    means = draws.agg(F.avg("n"), F.avg("m"), F.max("z")).first()
    assert abs(means[0] - 2.5) < 0.05 and abs(means[1] - 0.3) < 0.03 and means[2] == 0
    first = mixture.interleave(docs).orderBy("turn", "source").limit(20).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in first} == {"en": 10, "mn": 10}
    assert [r.doc_id for r in mixture.shuffled(docs, 1, "doc_id").collect()] == [r.doc_id for r in mixture.shuffled(docs, 1, "doc_id").collect()]
    domain = mixture.classify_record(F.col("source"), F.col("text"), {"a": ("mn",), "b": ("e",)})
    assert {r.doc_id for r in mixture.capped_seed(docs, domain, 3).collect()} == {0, 100}


def test_packing(spark):
    rows = [(i, [i] * n, [i] * n) for i, n in enumerate([3, 4, 2, 0, 9, 1])]
    d = spark.createDataFrame(rows, "doc_id long, ids array<int>, labels array<int>")
    packed = T.pack_rows(d, 8, 99, groups=1).orderBy("pack").collect()
    assert [(r.ids, r.num_samples) for r in packed] == [([0, 0, 0, 99, 1, 1, 1, 1], 2), ([2, 2], 1), ([4] * 8, 1), ([5], 1)]
    assert packed[0].labels[3] == 99
    with pytest.raises(ValueError):
        T.pack_rows(d, 0, 99)
    shards = T.shard_ids(d.select(F.lit(0).cast("long").alias("grp"), F.col("doc_id").alias("position"), F.size("ids").alias("size")), 7)
    assert [r.shard for r in shards.orderBy("position").collect()] == [0, 0, 1, 1, 2, 3]


def test_labels_and_truncation(spark):
    d = spark.createDataFrame([(1, [5, 6, 7, 8, 9], [-100, 6, 7, -100, -100]), (2, [1, 2, 3, 4], [-100] * 4), (3, [1], [1])], "doc_id long, ids array<int>, labels array<int>")
    assert [r.ids for r in T.truncate(d, 2).orderBy("doc_id").collect()] == [[6, 7], [3, 4], [1]]
    assert d.select(T.labels(F.col("ids"), F.array(F.lit(6))).alias("x")).first().x == [5, -100, 7, 8, 9]
    assert T.span_mask([1, 90, 91, 7, 8, 92, 93, 2], [([90, 91], [92, 93])]) == [1, 0, 0, 0, 0, 0, 0, 1]
    assert T.span_mask([1, 90, 2], [([90], [91])]) == [1, 0, 0]
    assert T.find([1, 2], [], 0) == -1
    gate = T.gate_metrics(d, unk=9).first()
    assert (gate.num_samples, gate.n_unk, gate.n_supervised, gate.passed) == (3, 1, 3, False)
    assert d.select(T.pad(F.col("ids"), F.lit(6), 0).alias("x")).first().x == [5, 6, 7, 8, 9, 0]


def test_word_positions(spark):
    tokens = [("mn", 0, 2), ("mn", 2, 4), ("general_punct", 4, 5), ("mn", 5, 6), ("mn", 7, 8), ("x", -1, -1), ("general", 8, 9)]
    rows = [(1, k, *t) for k, t in enumerate(tokens)]
    out = T.word_positions(spark.createDataFrame(rows, "doc_id long, pos long, track string, start long, end long")).orderBy("pos").collect()
    assert [(r.word_pos, r.morph_depth) for r in out] == [(0, 0), (0, 1), (0, 0), (1, 0), (2, 0), (2, 0), (3, 0)]


def test_chat_rows(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "AB"), (2, 0, "user", "only")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    row = C.sft_rows(d).collect()
    assert len(row) == 1 and [x for x in row[0].labels if x != -100] == [65, 66, 257] and row[0].ids[0] == 256
    assert C.render(d.where("conv_id = 1")).first().rendered == "<|system|>\nS\n<|user|>\nQ\n<|assistant|>\nAB"
    assert C.generation_prompts(d.where("conv_id = 2")).first().prompt == "<|user|>\nonly\n<|assistant|>\n"
    with pytest.raises(Exception, match="unknown role"):
        C.render(d.withColumn("role", F.lit("robot"))).collect()


def test_rewards(spark):
    def of(f, a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first().x

    assert of(C.exact_reward, "  Hello ", "hello") == 1
    assert of(C.numeric_reward, "it is 41 or 42", "42.0") == 1 and of(C.numeric_reward, "none", "42") == 0
    assert of(lambda a, b: C.format_reward(a), "<think>x</think> yes", "") == 1
    assert of(lambda a, b: C.format_reward(a), "<think>x</think><think>y</think> yes", "") == 0
    assert of(lambda a, b: C.total_reward(a, b, exact=1.0, numeric=0.5), "42", "42") == 1.5
    assert of(lambda a, b: C.purity_reward(a, 0.5), "аб x", "") == 2 / 3 and of(lambda a, b: C.purity_reward(a, 0.9), "аб x", "") == 0
    g = C.group_advantages(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g long, reward double"), "g")
    assert sorted(round(r.advantage, 3) for r in g.collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_error_rates(spark):
    assert E.edit_distance("kitten", "sitting") == 3 and E.edit_distance("", "abc") == 3 and E.edit_distance("a b x d".split(), "a b c d".split()) == 1
    rng = random.Random(0)
    for _ in range(50):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _step(row, i, x, b)
        assert E.edit_distance(a, b) == row[-1]
    d = spark.createDataFrame([("abc", "abc", 0.9), ("xyz", "xyq", None)], "pred string, ref string, confidence double")
    assert E.error_rate(d).first().cer == 1 / 6
    r = E.ocr_report(d, 0.5).first()
    assert (r.n, r.norm_cer, r.line_exact, r.rejection_rate) == (1, 0.0, 1.0, 0.5)
    base = spark.createDataFrame([("\u1820\u180b", "\u1820", 1.0)], "pred string, ref string, confidence double")
    report = E.ocr_report(base).first()
    assert report.raw_cer == 1.0 and report.grapheme_cer == 1.0 and report.norm_cer == 0.0


def _step(row, i, x, b):
    new = [i + 1]
    for j, y in enumerate(b):
        new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
    return new


def test_spans(spark):
    d = spark.sql("SELECT array(named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 6), named_struct('start', 2, 'end', 1)) t, array(3, 4) b, array(named_struct('start', 0, 'end', 4)) s")
    assert d.select(E.crossed_boundaries(F.col("t"), F.col("b"))).first()[0] == 1
    assert d.select(F.size(E.contained_tokens(F.col("t"), F.col("s")))).first()[0] == 2
    assert d.select(E.offset_faults(F.col("t"))).first()[0] == 2
    m = spark.sql("SELECT array(1.0D, 2.0D, 4.0D) v, array(1.0D, 0.0D, 1.0D) m")
    assert m.select(E.masked_mean(F.col("v"), F.col("m"))).first()[0] == 2.5
    p = spark.createDataFrame([(-1.0, -2.0, -1.5, -1.5)], "chosen double, rejected double, ref_chosen double, ref_rejected double")
    assert E.dpo_metrics(p).first().accuracy == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "Content": "x"}\n\nbroken\n"bare"\n{"Content": "two"}\n')
    got = {r.text for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), ("text", "Content")).collect()}
    assert got == {"one", "bare", "two"}
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), mark_bad=True).where("bad").count() == 1
    (tmp_path / "f.jsonl").write_text('{"q": "a", "r": " "}\n{"q": "b", "r": "c"}\n')
    assert {r.text for r in readers.read_jsonl_fields(spark, str(tmp_path / "f.jsonl"), ("q", "r")).collect()} == {"a", "b", "c"}
    assert {r.text for r in readers.read_jsonl_fields(spark, str(tmp_path / "f.jsonl"), ("q", "r"), joined=True).collect()} == {"a", "b\nc"}
    (tmp_path / "arr.json").write_text(json.dumps({"data": [{"q": "a"}, {"q": ""}, {"q": "b"}]}))
    assert [r.text for r in readers.read_json_array(spark, str(tmp_path / "arr.json"), ("q",)).orderBy("pos").collect()] == ["a", "b"]
    (tmp_path / "deep.json").write_text(json.dumps({"x": [{"title": "T", "author": "A", "paragraphs": ["p", "q"]}, {"instruction": "i", "output": "o"}]}))
    assert [r.text for r in readers.read_json_documents(spark, str(tmp_path / "deep.json")).orderBy("pos").collect()] == ["T\nA\np\nq", "i\no"]
    for name, data in {"u16.txt": "\ufeffᠠᠡ line one\nline two\n".encode("utf-16-le"), "gb.txt": "中文一行\n".encode("gb18030"), "u8.txt": "é\n\nz\n".encode()}.items():
        (tmp_path / name).write_bytes(data)
    lines = readers.read_lines(spark, [str(tmp_path / n) for n in ("u16.txt", "gb.txt", "u8.txt")])
    assert {r.text for r in lines.collect()} == {"ᠠᠡ line one", "line two", "中文一行", "é", "z"}
    assert [r.input_pos for r in readers.with_position(lines).orderBy("path", "pos").collect()] == [0, 1, 2, 3, 4]
    (tmp_path / "p.txt").write_text("one\ntwo\n\n\n\nthree")
    assert {r.text for r in readers.read_paragraphs(spark, str(tmp_path / "p.txt")).collect()} == {"one\ntwo", "three"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.jsonl", '{"text": "in zip"}\n')
        z.writestr("b.txt", "whole text")
        z.writestr("c.jpg", "no")
    assert {r.text for r in readers.read_zip(spark, str(tmp_path / "z.zip")).collect()} == {"in zip", "whole text"}
    (tmp_path / "h.html").write_bytes('<meta charset="gb2312"><title>标题</title><p>正文</p>'.encode("gb18030"))
    assert readers.read_html(spark, str(tmp_path / "h.html")).first().text == "标题\n正文"
    spark.createDataFrame([("a", None), (None, "b")], "text string, other string").write.parquet(str(tmp_path / "t.parquet"))
    assert {r.text for r in readers.read_parquet_text(spark, str(tmp_path / "t.parquet"), ("text", "other", "none")).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        readers.read_parquet_text(spark, str(tmp_path / "t.parquet"), ("none",))
    assert readers.infer_format("x/y.ndjson") == "jsonl" and readers.infer_format("x.bin") == "jsonl" and readers.infer_format("a.htm") == "html"
    assert readers.detect_encoding("é".encode()[:1] and "aé".encode()[:2]) == "utf-8" and readers.detect_encoding(b"") == "utf-8"
    text = spark.createDataFrame([("http://a.b\nword\n\nслово",)], "t string")
    assert text.select(readers.keep_lines(F.col("t"), strip_urls=True)).first()[0] == "word\n\nслово"
    assert text.select(readers.keep_lines(F.col("t"), script_class="а-я")).first()[0] == "слово"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "doc_id long, text string")
    m = sinks.write_shards(d, str(tmp_path / "s"), F.length("text"), 25, groups=1).collect()
    assert len(m) == 5 and all(len(r.sha256) == 64 for r in m)
    assert spark.read.json(str(tmp_path / "s")).groupBy("shard").count().agg(F.max("count")).first()[0] == 2
    sinks.write_jsonl(d, str(tmp_path / "j"))
    sinks.write_jsonl(d, str(tmp_path / "j"), append=True, min_chars=11)
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    sinks.write_buckets(d.withColumn("bucket", F.col("doc_id") % 2), str(tmp_path / "b"), "bucket")
    assert spark.read.json(str(tmp_path / "b")).where("bucket = 1").count() == 5
    counts = d.groupBy((F.col("doc_id") % 2).alias("k")).count()
    assert "| 0 | 5 |" in sinks.dataset_card("n", counts, "k", "count") and json.loads(sinks.report(counts))


def test_streaming_keeps_state_between_runs(spark, tmp_path):
    src, out, state, check = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    schema = "doc_id long, text string"
    first = [(1, LINE * 30), (2, LINE * 30), (3, "short"), (4, "a text by itself that is long enough to pass")]
    spark.createDataFrame(first, schema).coalesce(1).write.json(src)
    run = lambda: ingest.clean_stream(ingest.read_stream(spark, src, schema), out, state, check).awaitTermination()
    run()
    assert {r.doc_id for r in spark.read.parquet(out).collect()} == {1, 4}
    second = [(5, "a text by itself that is long enough to pass"), (6, LINE * 30 + "small appendix"), (7, "one more text that nobody has seen before this run")]
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").json(src)
    run()
    assert {r.doc_id for r in spark.read.parquet(out).collect()} == {1, 4, 7}
    run()
    assert spark.read.parquet(out).count() == 3
