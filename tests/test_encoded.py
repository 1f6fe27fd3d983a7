"""The queries against their SQL, and what SQL doesn't show: sequential versions of positions, merges, truncation, streams."""

import json
import random

import duckdb
import pytest
from lakecorpus.operators import dual, lookups, mixture, quality, reports, training_rows
from lakecorpus.queries.encoded import QUERIES, _dual
from lakecorpus.sources import readers
from lakecorpus.streaming import ranks
from pyspark.sql import functions as F

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("documents", "benchmark", "events", "customer", "embeddings", "orders", "lineitem", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_its_sql(spark, db, name):
    f, sql = QUERIES[name]
    got, want = f(spark, AT), db.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def sequential(ids, word, morpheme, cap=None):
    out, at, depth = [], -1, 0
    for i in ids:
        if i == word:
            at, depth = at + 1, 0
        elif i == morpheme:
            depth = depth + 1 if cap is None else min(depth + 1, cap - 1)
        elif i < 256:
            depth = 0
        elif at < 0:
            at, depth = 0, 0
        out.append((max(at, 0), depth if i == morpheme or i >= 256 else 0))
    return out


def test_boundary_positions(spark):
    rng = random.Random(4)
    rows = {d: [rng.choice([17, 18, 18, 5, 300, 301]) for _ in range(rng.randint(1, 25))] for d in range(120)}
    t = spark.createDataFrame([(d, k, i) for d, ids in rows.items() for k, i in enumerate(ids)], "doc_id long, pos long, id long")
    for cap in (None, 3, 0):
        got = {}
        for r in training_rows.positions_from_boundaries(t, 17, 18, max_depth=cap).orderBy("doc_id", "pos").collect():
            got.setdefault(r.doc_id, []).append((r.word_pos, r.morph_depth))
        assert got == {d: sequential(ids, 17, 18, cap or None) for d, ids in rows.items()}


def test_boundary_tracks_stay_in_their_row(spark):
    """positions within a row's array equal those of exploded tokens, over parts of rows and with nulls, and boundary_positions shuffles nothing."""
    rng = random.Random(6)
    rows = {d: [rng.choice([17, 18, 18, 5, 300, 301]) for _ in range(rng.choice([0, 1, 9, 40_000 if d < 9 else 30]))] for d in range(200)}
    d = spark.createDataFrame([*rows.items(), (900, None)], "doc_id long, ids array<int>").coalesce(1)
    for cap in (None, 3, 0):
        got = {r.doc_id: r.p for r in d.select("doc_id", training_rows.boundary_tracks(F.col("ids"), 17, 18, max_depth=cap).alias("p")).collect()}
        assert got.pop(900).word_pos is None
        assert {k: list(zip(p.word_pos, p.morph_depth)) for k, p in got.items()} == {k: sequential(ids, 17, 18, cap or None) for k, ids in rows.items()}
    plan = QUERIES["boundary_positions"][0](spark.newSession(), "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_offsets_are_counted_in_bounded_time(spark):
    """tokens without offsets don't count, nor is a text's length counted anew for each of its tokens."""
    token = "array<struct<start:int,end:int>>"
    rows = [("a", 10, [(0, 3), (-1, -1), (2, 11), (1, 0)]), ("a", 10, []), ("a", 10, None), ("b", None, [(-1, 4), (0, None), (3, 4)]), ("c", 5, [(-1, -1)])]
    got = {r.k: tuple(r)[1:] for r in reports.offset_report(spark.createDataFrame(rows, f"k string, n_chars int, tokens {token}"), "k").collect()}
    assert got == {"a": (3, 2, 1), "b": (3, 1, 0), "c": (0, 0, 0)}
    plan = QUERIES["offset_report"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "> length(text" not in plan


def test_bytes_marks_and_padding_in_parts(spark, tmp_path):
    """ids of bytes, their text with marks, and batches with null, empty and long rows, in several parts, against plain Python and the SQL. No text is matched pair by pair."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab\n\u00e9\u4e2d") for _ in range(n))
    rows = [(k, None if k % 11 == 4 else text(rng.choice([0, 3, 50, 150_000 if k in (20, 21, 40) else 20]))) for k in range(96) if k // 8 != 7]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ids = d.select("doc_id", training_rows.byte_ids(F.col("text"), 3).alias("ids"), training_rows.byte_ids(F.col("text")).alias("plain")).coalesce(1)
    assert "regexp_extract_all" not in ids._jdf.queryExecution().optimizedPlan().toString()
    marked = ids.select("doc_id", "ids", training_rows.hex_text(F.array_append("plain", F.lit(256)), {256: "--"}).alias("h"), training_rows.bytes_of(F.array_prepend("plain", F.lit(-100))).alias("b"))
    got = {r.doc_id: (r.ids, r.h, r.b) for r in marked.collect()}
    assert got == {k: (None, None, None) if t is None else ([b + 3 for b in t.encode()], t.encode().hex() + "--", bytearray(t.encode())) for k, t in rows}
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = QUERIES["collated"]
    made = query(spark, str(tmp_path))
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(r)
    assert sorted(map(key, made.collect())) == sorted(db.sql(sql).fetchall())


def test_span_truncation(spark):
    rows = [(1, list(range(10)), [(2, 5), (7, 9)], ["a", "b"]), (2, list(range(10)), [(5, 7)], ["a"]), (3, [1, 2], [], [])]
    d = spark.createDataFrame(rows, "doc_id int, ids array<int>, spans array<struct<start:int,end:int>>, images array<string>").withColumn("labels", F.col("ids"))
    got = {r.doc_id: (len(r.ids), len(r.labels), len(r.spans), r.images, r.truncated) for r in training_rows.truncate_spans(d, 6, media=("images",)).collect()}
    assert got == {1: (6, 6, 1, ["a"], True), 2: (5, 5, 0, [], True), 3: (2, 2, 0, [], False)}


def test_normalize_and_collate(spark):
    d = spark.createDataFrame([(1, [1, 2, 3], True), (2, [4], False)], "doc_id int, ids array<int>, has_media boolean")
    with pytest.raises(Exception, match="too long"):
        training_rows.normalize_rows(d, 2).collect()
    got = training_rows.normalize_rows(d, 3).withColumn("b", F.lit(0))
    row = training_rows.collate(got, "b", 9).first()
    assert (row.ids, row.labels, row.mask) == ([[1, 2, 3], [4, 9, 9]], [[1, 2, 3], [4, -100, -100]], [[1, 1, 1], [1, 0, 0]])


def test_files_of_ranks(spark):
    files = spark.createDataFrame([("c",), ("a",), ("b",)], "path string")
    assert {(r.path, r.rank, r.worker) for r in ranks.deal_files(files, 2, 2).collect()} == {("a", 0, 0), ("b", 1, 0), ("c", 0, 1)}
    everyone = ranks.deal_files(files, 4, 2).collect()
    assert len(everyone) == 12 and {r.rank for r in everyone if r.path == "b"} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="no rows"):
        ranks.epochs(spark.createDataFrame([], "doc_id long"), 2).collect()
    drawn = ranks.epochs(spark.range(40).withColumnRenamed("id", "doc_id"), 3, 1)
    order = [[r.doc_id for r in drawn.where(F.col("epoch") == e).orderBy("draw").collect()] for e in range(3)]
    assert all(sorted(o) == list(range(40)) for o in order) and order[0] != order[1] != order[2]
    left = ranks.resume(ranks.batches(drawn, 10), 2, 3).collect()
    assert {r.batch for r in left} == set(range(6, 12)) and len(left) == 60


def test_capped_seed_takes_no_key_of_a_full_domain(spark):
    rows = [(1, "a1"), (2, "a2"), (3, "a common"), (4, "b common"), (5, "b2"), (6, "a1")]
    d = spark.createDataFrame([(k, t[:1], t[1:]) for k, t in rows], "doc_id long, domain_ string, text string")
    got = {(r.doc_id, r.domain, r["rank"]) for r in mixture.capped_seed(d, F.col("domain_"), 2).collect()}
    # 3 came when its domain was full, so its text is still free for 4
    assert got == {(1, "a", 1), (2, "a", 2), (4, "b", 1)}
    rng = random.Random(7)
    for _ in range(3):
        rows = [(k, rng.choice("abc"), rng.choice("uvwxyz") * 2) for k in range(60)]
        count, seen, want = {}, set(), set()
        for k, dom, t in rows:
            if count.get(dom, 0) < 3 and t not in seen:
                seen.add(t)
                count[dom] = count.get(dom, 0) + 1
                want.add((k, dom, count[dom]))
        d = spark.createDataFrame(rows, "doc_id long, domain_ string, text string")
        assert {(r.doc_id, r.domain, r["rank"]) for r in mixture.capped_seed(d, F.col("domain_"), 3).collect()} == want


def test_lines_of_running_text(spark):
    mn = "ᠮᠣᠩᠭᠣᠯ"
    text = f"{mn} line\n\nCopyright {mn} x\n* * * --\nabc\n{'latin words that go on for more than forty signs'}\nᠭᠠᠷᠴᠠᠭ ()\nhttp://x.y {mn}"
    got = spark.createDataFrame([(text,)], "t string").select(quality.running_lines(F.col("t")).alias("x")).first().x
    assert got == f"{mn} line\nlatin words that go on for more than forty signs\n{mn}"


def test_json_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"x": "one", "y": "two"}, {"y": ""}, {"x": "three"}]')
    (tmp_path / "b.json").write_text('{"x": "one", "y": "two"}\n{"x": "three"}\n')
    (tmp_path / "c.json").write_text("[" * 100_000)
    for name, joined, want in (("a", True, {"one\ntwo", "three"}), ("b", True, {"one\ntwo", "three"}), ("a", False, {"one", "two", "three"}), ("b", False, {"one", "two", "three"}), ("c", False, set())):
        assert {r.text for r in readers.read_json_fields(spark, str(tmp_path / f"{name}.json"), ("x", "y"), joined).collect()} == want
    assert readers.read_json_documents(spark, str(tmp_path / "c.json")).count() == 0


def test_sidecars_and_alignment(spark):
    assert [spark.range(1).select(lookups.stem(F.lit(p)).alias("s")).first().s for p in ("a/b.c.png", "a.b/c", "x/.hidden")] == ["a/b.c", "a.b/c", "x/.hidden"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string"), spark.createDataFrame([(1, "u"), (3, "v")], "k int, r string")
    with pytest.raises(Exception, match="only one side"):
        lookups.aligned(a, b, "k").collect()


def test_ranks_in_order(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    got = reports.ranked(spark.createDataFrame(rows, "a int, b int").repartition(7), F.col("a").desc(), F.col("b")).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.a, r.b))] == list(range(1, 501))


def merged(word, merges, wall=()):
    parts = [(c, k, k + 1) for k, c in enumerate(word)]
    while True:
        best = min(((merges[a[0], b[0]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a[0], b[0]) in merges and a[2] not in wall), default=None)
        if best is None:
            return parts
        k = best[1]
        parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1], parts[k + 1][2])]


def test_merges_equal_the_plain_loop():
    rng = random.Random(5)
    letters = "ᠠᠡᠢᠣ"
    merges, surfaces = {}, list(letters)
    while len(merges) < 40:
        pair = (rng.choice(surfaces), rng.choice(surfaces))
        if pair not in merges and len("".join(pair)) < 7:
            merges[pair] = len(merges)
            surfaces.append("".join(pair))
    vocabulary = {t: k for k, t in enumerate(["<unk>", *dict.fromkeys(surfaces)])}
    wall = {2, 5}
    for boundaries in (None, lambda w: wall):
        p = dual.Pieces(vocabulary, merges, boundaries)
        for _ in range(200):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 15)))
            assert [(t, a, b) for _, t, a, b in p.encode(word)] == merged(word, merges, wall if boundaries else ())
            assert p.decode(i for i, *_ in p.encode(word)) == word
    p = dual.Pieces(vocabulary, merges)
    assert [(a, b) for _, _, a, b in p.encode(" ᠠ ᠡ᠋\tᠢ")] == [(1, 2), (3, 5), (6, 7)]
    hard = dual.Pieces(dual.with_controls(vocabulary), merges)
    assert [t for _, t, _, _ in hard.encode("ᠠ᠋ᠡ")] == ["ᠠ", "᠋", "ᠡ"]
    assert hard.decode(i for i, *_ in hard.encode("ᠠ᠋ᠡ")) == "ᠠ᠋ᠡ" and p.decode([0]) == "�"


def tokenizer():
    import public_tokenizers

    general = dual.General(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {t: k for k, t in enumerate(["<unk>", *"ᠮᠣᠩᠭᠯᠠ", "ᠮᠣ", "a"])}
    v = dual.unified(pieces, general.vocabulary, (300, 400), (400, 70_000))
    return dual.DualTokenizer(v, dual.Pieces(pieces, {("ᠮ", "ᠣ"): 0}), general, (400, 70_000))


def test_two_tracks(spark, tmp_path):
    t = tokenizer()
    text = "Hello, a ᠮᠣᠩᠭᠣᠯ 中文 é <image> 12."
    got = t.tokens(text, bos=True, eos=True)
    assert [x[2] for x in got][0] == "special" and {x[2] for x in got} == {"special", "space", "mn", "general", "general_punct"}
    assert t.decode(x[0] for x in got) == text
    # a surface of both tracks has one id, and the general track reaches it
    assert t.vocabulary["a"] < 400 and t.vocabulary["a"] in {x[0] for x in got if x[2] == "general"}
    assert all(text[a:b] == s for _, s, track, a, b in got if track == "mn")
    assert "".join(t.stream([x[0] for x in got])) == text
    assert t.decode(t.lossless(text + "\U0001f600ä")) == text + "\U0001f600ä"
    t.save(str(tmp_path / "t.json"))
    again = dual.load(str(tmp_path / "t.json"), t.general, (400, 70_000))
    assert again.encode(text) == t.encode(text)
    saved = json.loads((tmp_path / "t.json").read_text())
    saved["vocabulary"]["<bos>"] = 1
    (tmp_path / "t.json").write_text(json.dumps(saved))
    with pytest.raises(ValueError, match="twice"):
        dual.load(str(tmp_path / "t.json"), t.general, (400, 70_000))
    import functools

    import public_tokenizers

    make = functools.partial(_dual, public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.createDataFrame([(text,), (None,), ("",)], "x string").select("x", dual.encode_column(F.col("x"), make).alias("t"))
    d = d.select("x", "t", dual.decode_column(F.transform("t", lambda s: s["id"]), make).alias("back"))
    assert [(r.back, len(r.t) > 0) for r in d.collect()] == [(text, True), ("", False), ("", False)]


def test_media_spans_and_failures(spark):
    from lakecorpus.operators import gate

    none = [-100] * 6
    rows = [
        (1, [9, 5, 7, 7, 6, 8], none, [(1, 5)], ["a"]),
        (2, [9, 5, 7, 7, 7, 8], none, [(1, 5)], ["a"]),
        (3, [9, 5, 7, 7, 6, 8], [-100, -100, 7, -100, -100, 8], [(1, 5), (4, 9), (2, 3)], ["a"]),
        (4, [1], [1, 2], [], []),
    ]
    d = spark.createDataFrame(rows, "doc_id int, ids array<int>, labels array<int>, spans array<struct<start:int,end:int>>, images array<string>")
    got = {(r.doc_id, r.rule, r.at) for r in gate.failures(d, 10, media={"spans": ("images", 5, 6)}).collect()}
    assert got == {(2, "spans_markers", 0), (3, "spans_labelled", 0), (3, "spans_bounds", 1), (3, "spans_short", 2), (3, "images_count", -1), (4, "labels_length", -1)}
    one = spark.range(1).select(gate.nested(F.array(F.lit(1), F.lit(2))).alias("a"), gate.nested(F.lit(None).cast("array<int>")).alias("b")).first()
    assert (one.a, one.b) == ([[1, 2]], [])


def test_files_in_and_out(spark, tmp_path):
    from lakecorpus.sources import sinks

    d = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "k int, text string")
    sinks.write_lines(d, str(tmp_path / "lines"))
    assert {r.value for r in spark.read.text(str(tmp_path / "lines")).collect()} == {"one two", "three"}
    sinks.write_status(spark, str(tmp_path / "status"), done=3, loss=float("nan"))
    assert json.loads(spark.read.text(str(tmp_path / "status")).first().value) == {"done": 3, "loss": None}
    for name, lines in (("a", 3), ("b", 2), ("c", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"ids": [k], "f": name}) + "\n" for k in range(lines)))
    (tmp_path / "note.xyz").write_text("no")
    at = str(tmp_path / "*.*")
    assert {(r.path.rpartition("/")[2], r.kind) for r in readers.units(spark, at).collect()} == {("a.jsonl", "jsonl"), ("b.jsonl", "jsonl"), ("c.jsonl", "jsonl")}
    assert [readers.read_training_rows(spark, at, r, 2).count() for r in (0, 1)] == [4, 2] and readers.read_training_rows(spark, at, 3, 5).count() == 6
    (tmp_path / "t.jsonl").write_text('{"text": "x"}\n"y"\n\n')
    assert [r.text for r in readers.read_required_text(spark, str(tmp_path / "t.jsonl")).orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "t.jsonl").write_text('{"text": "x"}\n[1]\n')
    with pytest.raises(Exception, match="t.jsonl:2: no text"):
        readers.read_required_text(spark, str(tmp_path / "t.jsonl")).collect()
    readers.source("mine", "b")(lambda s: s.createDataFrame([("p", "t")], "path string, text string"))
    assert [tuple(r) for r in readers.read_sources(spark, "mine").collect()] == [("p", "t", "mine", "b")]
