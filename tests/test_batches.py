import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from lakecorpus.functions import metrics as M
from lakecorpus.functions.batches import list_places, lists_of, parts
from lakecorpus.operators import media, mixture, tokens, training_rows
from lakecorpus.queries import QUERIES
from pyspark.sql import functions as F


def test_parts_are_bounded_and_whole():
    texts = pa.array(["a" * n for n in (10, 0, 300, 5)] + [None] + ["b" * 90] * 20)
    got = list(parts(texts, 100))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == len(texts)
    sizes = [sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) for a, b in got]
    assert max(s for s in sizes if s != 300 and s < 300) < 200 and len(got) > 15
    assert list(parts(pa.array([], type=pa.string()))) == []
    assert list(parts(pa.array([[1] * 60, None, [2] * 60]), 100)) == [(0, 2), (2, 3)]


def test_lists():
    schema = pa.struct([("a", pa.int32()), ("b", pa.string())])
    lists = lists_of([2, 0, 1], [(1, 2, 3), ("x", "y", "z")], schema)
    assert [len(x) for x in lists.to_pylist()] == [2, 0, 1] and lists.to_pylist()[2] == [{"a": 3, "b": "z"}]
    at, flat = list_places(pa.array([[1, 2], None, [3]]))
    assert at.tolist() == [0, 2, 2, 3] and flat.to_pylist() == [1, 2, 3]


def test_spans_of_texts_over_several_parts(spark):
    d = spark.createDataFrame([(k, None if k == 3 else f"w{k} " * 30_000) for k in range(5)], "k long, text string").coalesce(1)
    got = {r.k: r.n for r in d.select("k", F.size(tokens.segment(F.col("text"))).alias("n")).collect()}
    assert got == {0: 60_000, 1: 60_000, 2: 60_000, 3: 0, 4: 60_000}


def test_media_in_their_rows_are_as_in_tables_of_tokens(spark):
    rows = [(1, "a <image> b<video>c", [2], [1]), (2, "no media", None, []), (3, "<image><image>", [1, None], None), (4, "字<video>é", [], [3]), (5, "", [], []), (6, "x <images> <image", [], []), (7, "w " * 300 + "<image>" + " v" * 9, [5], []), (8, None, None, None)]
    texts = media.expand(spark.createDataFrame(rows, "doc_id long, text string, image_patches array<int>, video_patches array<int>")).coalesce(1)
    tokens_ = media.annotate(media.tokenized(texts), texts)
    d = texts.select("doc_id", media.in_rows(F.col("expanded"), F.col("edits")).alias("x"))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    mine = {(r.doc_id, r.pos, *r.col) for r in d.select("doc_id", F.posexplode("x.tokens")).collect()}
    assert mine == {(r.doc_id, r.pos, r.token, r.start, r.end, r.image_index, r.video_index) for r in tokens_.collect()}
    spans = {(r.doc_id, *r.x) for r in d.select("doc_id", F.explode("x.spans").alias("x")).collect()}
    assert spans == {tuple(r) for r in media.media_spans(tokens_, texts).collect()}
    edit = pa.array([[{"kind": "image", "index": 0, "patches": 1, "start": 0, "end": 7, "out_start": 0, "out_end": 34}]])
    for text in ("<image_start><image_patch><image_end>", "<image_start><image_end>"):
        with pytest.raises(ValueError, match="don't match"):
            media._placed(media._annotated(media._words(pa.array([text])), edit.slice(0, 1) if "patch" not in text else pa.array([[]], type=edit.type)), edit)


def test_counts_of_texts_make_no_regular_expressions(spark):
    texts = ["", None, " 　 a1 b2 c3 d4 e5  ", "中文 abc #|# \n\nx\n x \n", "a中 b 12 ᠎", "\U0001f600 \U00010400x", "\x1c\x1da"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    columns = {"n": M.token_count(F.col("text")), "r": M.repeated_line_fraction(F.col("text")), "s": M.symbol_to_word_ratio(F.col("text")), "w": M.mean_word_length(F.col("text")), "p": M.token_proxy(F.col("text")), "v": M.visible(F.col("text"))}
    made = d.select("k", *[c.alias(n) for n, c in columns.items()])
    assert "regexp" not in made._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.k: tuple(r)[1:] for r in made.collect()}
    assert got[0] == (0, 0.0, 1.0, None, 1, 0) and got[1] == (None, None, 1.0, None, 1, None)
    assert got[2] == (5, 0.0, 0.0, 2.0, 5, 10) and got[3] == (6, 1 / 3, 3 / 6, None, 5, 10)
    assert got[4][0] == 5 and got[5][0] == 2 and got[6][0] == 1


def test_places_of_a_mixture_are_ranked_without_texts(spark):
    rows = [(s, p, "x y " * n) for s in ("a", "b", None) for n, p in enumerate([None, 1, 2, 3, 4, 5], 1)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    out = mixture.measure(docs, sample=3)
    assert {(r.source, r.n_docs, r.n_chars, r.sample_tokens, r.sample_chars) for r in out.collect()} == {(s, 6, 84, 12, 24) for s in ("a", "b", None)}
    plan = [x.lstrip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    below = [next(x for x in plan[k:] if x.startswith(("Project", "Relation", "LogicalRDD"))) for k, x in enumerate(plan) if x.startswith("Window")]
    assert below and not any(" text#" in x for x in below)


def test_over_long_rows_are_cut_without_functions_of_each_token(spark, tmp_path):
    rng = random.Random(7)
    rows = [[rng.choice([-100, -100, -100, 5, 6, None]) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    d = spark.createDataFrame([(k, list(range(len(x))), x) for k, x in enumerate(rows)] + [(300, None, None)], "k long, ids array<int>, labels array<int>")
    cut = training_rows.truncate(d, 4)
    assert "lambda" not in cut._jdf.queryExecution().executedPlan().toString()
    for r in cut.collect():
        if r.k == 300:
            assert r.ids is r.labels is None
            continue
        row = rows[r.k]
        last = max((i for i, x in enumerate(row) if x not in (None, -100)), default=len(row) - 1)
        s = max(0, last + 1 - 4) if len(row) > 4 else 0
        assert (r.ids, r.labels) == (list(range(len(row)))[s : s + 4], row[s : s + 4])
    texts = ["", None, "a b", " " * 700, "é" * 600, "x" * 400 + " " + "y" * 600, "w" * 900 + " z", "q " + "ü" * 150_000, " " + "k" * 600]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["truncate_rows"][0](spark, str(tmp_path))
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(db.sql(QUERIES["truncate_rows"][1]).fetchall())


def test_ocr_rows_are_built_and_split_within_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [([rng.randint(0, 255) for _ in range(rng.randint(0, 4))], [rng.choice([1, 2, 94]) for _ in range(rng.randint(1, 6))]) for _ in range(60)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, instruction array<int>, target array<int>").coalesce(1)
    built = tokens.ocr_rows(d, 2, 90, 91, 92, 93, 94)
    back = {r.k: r for r in tokens.split_ocr_rows(built.drop("target"), 94).collect()}
    ids, labels = tokens.ocr_lists(*(pa.array([r[c] for r in rows], type=pa.list_(pa.int32())) for c in (0, 1)), 2, 90, 91, 92, 93, 94)
    prompts, targets = tokens.split_ocr_lists(ids, labels, 94)
    for k, x in enumerate(zip(*(c.to_pylist() for c in (ids, labels, prompts, targets)), strict=True)):
        assert x == (back[k].ids, back[k].labels, back[k].prompt, back[k].target)
    none = pa.array([[]], type=pa.list_(pa.int32()))
    assert tokens.split_ocr_lists(pa.array([[7, 8]], type=pa.list_(pa.int32())), none, 94)[1].to_pylist() == [[7, 8]]
    texts = [(0, "", "en"), (1, None, "en"), (2, "é x", None), (3, "ab" * 200_000, "fr"), (4, "z", ""), (5, "字\n", "zh")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["ocr_rows"][0](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array" not in plan and plan.count("MapInArrow") == 1  # no row's ids leave the pass
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(db.sql(f"SELECT {columns} FROM ({QUERIES['ocr_rows'][1]})").fetchall())


def test_spans_are_encoded_once_and_tokens_stay_in_the_task(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from lakecorpus.operators import dual
    from lakecorpus.queries.encoded import _dual

    t = _dual(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    pieces = ["a", "b", "<", "<bos>", "<im", " ", " ", " ", "ᠮ", "ᠣ", "ᠩ", "᠂", "\n", "é", "中", "1", ".", "\U0001f600", "▁", "the", "�"]
    for n in range(60):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 9))]
        got = t.encode_texts(texts, n % 2 == 0, n % 3 == 0)
        for a, b, text in zip(got.at[:-1], got.at[1:], texts, strict=True):
            row = [(i, got.names[k].as_py(), dual.TRACKS[x], s, e) for i, k, x, s, e in zip(*(c[a:b].tolist() for c in (got.ids, got.surfaces, got.tracks, got.starts, got.ends)), strict=True)]
            assert row == t.tokens(text, n % 2 == 0, n % 3 == 0)
        assert t.decode_lists(got.at, got.ids) == [t.decode(got.ids[a:b].tolist()) for a, b in zip(got.at[:-1], got.at[1:], strict=True)]
    ids = np.array([rng.choice([-1, 0, 5, 20, 200, 305, 24600, 30000, 200000]) for _ in range(400)], dtype=np.int32)
    at = np.arange(0, 401, 8)
    assert t.decode_lists(at, ids) == [t.decode(ids[a : a + 8].tolist()) for a in at[:-1]]
    words = [f"w{k}x" for k in range(50)]
    asked = []
    encode = t.general.encode_many
    t.general.encode_many = lambda some: asked.extend(some) or encode(some)
    for _ in range(3):
        t.encode_texts([" ".join(words)] * 20)
    assert sorted(asked) == sorted(words)
    rows = [(0, ""), (1, None), (2, "the que ᠮ é"), (3, "der  x\n" * 60_000), (4, "<bos> le")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["dual_tokens"][0](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.sql(QUERIES["dual_tokens"][1]).fetchall()}
    for k in (0, 1, 3):  # the SQL counts words of the script and of no text else
        assert got[k] == want[k]
    assert got[2][1:] == want[2][1:]
    assert got[4] == (0, 1, 8, hashlib.md5(b" le").hexdigest())  # special tokens decode to nothing


def test_word_positions_within_rows_are_those_of_token_tables(spark, tmp_path):
    import numpy as np

    rng = random.Random(9)
    rows = {d: [(rng.choice(["mn", "general", "x", "mn"]), *rng.choice([(k, k + 1), (k, k + 1), (k, k + 2), (-1, -1)])) for k in range(rng.randint(0, 14))] for d in range(80)}
    table = spark.createDataFrame([(d, k, *t) for d, r in rows.items() for k, t in enumerate(r)], "doc_id long, pos long, track string, start long, end long")
    want = [(r.word_pos, r.morph_depth) for r in training_rows.word_positions(table).orderBy("doc_id", "pos").collect()]
    flat = [t for r in rows.values() for t in r]
    columns = [np.array(c) for c in ([{"mn": 0, "general": 1}.get(t[0], -1) for t in flat], [t[1] for t in flat], [t[2] for t in flat])]
    at = np.r_[0, np.cumsum([len(r) for r in rows.values()])]
    assert [(a, b) for a, b in zip(*(x.tolist() for x in training_rows.word_tracks(at, *columns)), strict=True)] == want
    assert [len(x) for x in training_rows.word_tracks(np.zeros(3, dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * 3)] == [0, 0]
    texts = ["", None, "ab", "cd é字x", " \n1a", "\U0001f600ab\U0001f600", "Ab c, " * 60_000, "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["word_positions"][0](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(db.sql(QUERIES["word_positions"][1]).fetchall())
