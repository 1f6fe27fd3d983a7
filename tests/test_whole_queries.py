"""Queries that have to take whole tables and whole texts."""

import random

import duckdb
import pytest
from lakecorpus.functions.metrics import graphemes
from lakecorpus.operators import evaluation as E
from lakecorpus.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture
def tables(spark, tmp_path):
    """Makes tables of the test; gives the folder."""

    def make(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_edit_distance_of_graphemes_and_unequal_lengths(spark):
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("ab́ ᠠ᠋᠎") for _ in range(rng.choice([0, 1, 5, 70, 130]))) for _ in range(2)) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", E.grapheme_distance_udf()("a", "b").alias("d")).collect()
    assert all(r.d.codepoint == distance(r.a, r.b) and r.d.grapheme == distance(graphemes(r.a), graphemes(r.b)) for r in got)


def test_rates_of_whole_texts_and_all_items(spark, tables):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé à\n") for _ in range(n))
    items = [(7 * k + 3, text(rng.choice([60, 150]))) for k in range(50)]
    docs = [(k, text(rng.choice([0, 40, 200])) if k else None, rng.choice(["en", "fr"])) for k in range(120)]
    at = tables(benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string, lang string"))
    pairs = [(k, lang, t or "", items[k % 50][1]) for k, t, lang in docs]
    got = {r.lang: (r.n, r.edits, r.ref_chars) for r in QUERIES["error_rates"][0](spark, at).collect()}
    for lang in ("en", "fr"):
        mine = [(p, r) for _, x, p, r in pairs if x == lang]
        assert got[lang] == (len(mine), sum(distance(p, r) for p, r in mine), sum(len(r) for _, r in mine))
    kept = [(p, r) for k, _, p, r in pairs if k % 10 >= 3]
    flat = [(" ".join(p.split()), " ".join(r.split())) for p, r in kept]
    report = QUERIES["ocr_report"][0](spark, at).first()
    rate = lambda ps, of=lambda x: x: sum(distance(of(p), of(r)) for p, r in ps) / sum(max(len(of(r)), 1) for _, r in ps)
    assert report.n == len(kept) and report.rejection_rate == pytest.approx(0.3)
    assert (report.raw_cer, report.norm_cer, report.grapheme_cer, report.wer) == pytest.approx((rate(kept), rate(flat), rate(kept), rate(flat, str.split)))


def test_chunks_and_lines_of_whole_texts(spark, tables):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "bé", "w" * 9, "x" * 70, "see http://a.b/c?d", "mail me@x.org now"])
    docs = [(k, "\n".join(" ".join(word() for _ in range(rng.randrange(9))) for _ in range(rng.randint(1, 6)))) for k in range(40)] + [(40, None), (41, ""), (42, " one\n\n two  three\t\nfour")]
    at = tables(documents=(docs, "doc_id long, text string"))
    chunks = {}
    for r in QUERIES["chunk_words"][0](spark, at).orderBy("doc_id", "k").collect():
        chunks.setdefault(r.doc_id, []).append(r.line)
    assert {k: " ".join(v).split() for k, v in chunks.items()} == {k: t.split() for k, t in docs if t and t.split()}
    for lines in chunks.values():
        assert all(len(x) <= 60 or " " not in x for x in lines)
        assert all(len(x) + 1 + len(y.split()[0]) > 60 for x, y in zip(lines, lines[1:]))
    query, sql = QUERIES["running_lines"]
    got = sorted((r.doc_id, r.k, r.line) for r in query(spark, at).collect())
    assert [(k, x) for d, k, x in got if d == 42] == [(0, "one"), (1, ""), (2, "two three"), (3, "four")]
    assert len(got) == sum(t.count("\n") + 1 for _, t in docs if t is not None) and not any("http" in x or "@" in x for _, _, x in got)
    db = duckdb.connect()
    for folder in (f"{at}/documents.parquet/*.parquet", "/root/testdata/sf0.001/documents.parquet"):
        db.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}'")
        at = at if "*" in folder else "/root/testdata/sf0.001"
        assert sorted(map(tuple, query(spark, at).collect())) == sorted(db.sql(sql).fetchall())


def test_a_group_of_packs_is_dealt_to_several_tasks(spark):
    """rows of one group go to several tasks, cut where a pack begins, and the packs are those of one pass in order."""
    from lakecorpus.operators import training_rows as T

    rng = random.Random(12)
    rows = [(k, [k % 50] * rng.choice([0, 1, 3, 7, 9, 14])) for k in range(3000)]
    d = spark.createDataFrame([(k, x, x) for k, x in rows] + [(5000, None, None)], "doc_id long, ids array<int>, labels array<int>")
    packed = T.pack_rows(d, 10, 99, groups=1, block=500)
    assert packed.rdd.getNumPartitions() > 4
    want, samples = [], []
    for _, x in rows:
        x = x[:10]
        if x and want and len(want[-1]) + 1 + len(x) <= 10:
            want[-1], samples[-1] = [*want[-1], 99, *x], samples[-1] + 1
        elif x:
            want, samples = [*want, x], [*samples, 1]
    assert [(r.pack, r.ids, r.labels, r.num_samples) for r in packed.orderBy("pack").collect()] == [(k, x, x, n) for k, (x, n) in enumerate(zip(want, samples))]


def test_foreign_gates_of_all_rows(spark, tables):
    docs = [(1, None), (2, ""), (3, "short"), (4, "a" * 79), (5, "b" * 80), (6, " " * 50 + "c" * 60), (7, "d" * 119), (8, "e" * 120)]
    at = tables(documents=(docs, "doc_id long, text string"))
    query, sql = QUERIES["foreign_gates"]
    got = {r.doc_id: (r.mongolian, r.legal) for r in query(spark, at).collect()}
    short, script = "too_short", "script_impurity"
    assert got == {1: (short, short), 2: (short, short), 3: (short, short), 4: (short, short), 5: (script, short), 6: (short, short), 7: (script, short), 8: (script, script)}
    db = duckdb.connect()
    for folder, files in ((at, f"{at}/documents.parquet/*.parquet"), ("/root/testdata/sf0.01", "/root/testdata/sf0.01/documents.parquet")):
        db.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{files}'")
        assert sorted(map(tuple, query(spark, folder).collect())) == sorted(db.sql(sql).fetchall())


def test_near_duplicates_equal_a_pass_in_order(spark):
    """near_pairs and near_dedup over the whole tables against every pair, and a pass that compares each document to all kept ones."""
    at = "/root/testdata/sf0.001"
    d = QUERIES["near_dedup"][0](spark, at)
    from lakecorpus.functions import hashing as H
    from lakecorpus.operators import dedup
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{at}/documents.parquet")
    unique = dedup.exact_dedup(docs).select("doc_id", "text", H.simhash(F.col("text")).alias("sig")).orderBy("doc_id").collect()
    sigs = [(r.doc_id, r.sig & (2**64 - 1), len(r.text.split())) for r in unique]
    want = {(a, b, (x ^ y).bit_count()) for i, (a, x, _) in enumerate(sigs) for b, y, _ in sigs[i + 1 :] if (x ^ y).bit_count() <= 3}
    assert {(r.earlier, r.later, r.distance) for r in QUERIES["near_pairs"][0](spark, at).collect()} == want
    kept, ids = [], set()
    for k, x, n in sigs:
        if n >= 120:
            if any((x ^ y).bit_count() <= 3 for y in kept):
                continue
            kept.append(x)
        ids.add(k)
    assert {r.doc_id for r in d.collect()} == ids
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for x in base for _ in range(8))]
    signed = spark.createDataFrame([(i, x - (1 << 64) * (x >> 63)) for i, x in rows], "doc_id long, sig long")
    for t in (0, 1, 2, 3):
        got = {(r.earlier, r.later) for r in dedup.near_pairs(signed, t).collect()}
        assert got == {(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= t}


def test_packs_equal_a_pass_in_order(spark):
    """pack_rows over the whole table: each group packed by itself in a loop."""
    at = "/root/testdata/sf0.001"
    from lakecorpus.operators import training_rows as T
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("g")).orderBy("g", "doc_id").collect()
    want, at_pack = {}, {}
    for r in docs:
        ids = list(r.text.encode())[:8192]
        if not ids:
            continue
        packs = at_pack.setdefault(r.g, [])
        if packs and len(packs[-1][0]) + 1 + len(ids) <= 8192:
            packs[-1] = (packs[-1][0] + [256] + ids, packs[-1][1] + 1)
        else:
            packs.append((ids, 1))
    want = {(g, k): p for g, packs in at_pack.items() for k, p in enumerate(packs)}
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", T.byte_ids(F.col("text")).alias("ids")).withColumn("labels", T.labels(F.col("ids"), F.array(F.lit(10))))
    got = {(r.pack_group, r.pack): r for r in T.pack_rows(rows, 8192, 256).collect()}
    assert {k: (r.ids, r.num_samples) for k, r in got.items()} == want
    assert all(r.labels == [-100 if x == 10 else x for x in r.ids] for r in got.values())
    assert {(r.pack_group, r.pack, r.n, r.num_samples) for r in QUERIES["pack_rows"][0](spark, at).collect()} == {(g, k, len(ids), n) for (g, k), (ids, n) in want.items()}


def test_chunks_cover_each_text(spark):
    """split_documents over the whole table: chunks are of the size, in order, and hold all words; a chunk that could take the next part would have."""
    at = "/root/testdata/sf0.001"
    from lakecorpus.operators import chunking

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = {}
    for r in chunking.split_documents(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), 1000).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for k, text in docs.items():
        chunks = got.get(k, [])
        assert [w for c in chunks for w in c.split()] == text.split()
        if len(text) > 1000:
            assert all(0 < len(c) <= 1000 for c in chunks)


def test_html_text_of_articles(spark):
    """html_text over the whole table against the article cut out by hand."""
    import html
    import re

    at = "/root/testdata/sf0.001"
    from lakecorpus.functions import markup
    from pyspark.sql import functions as F

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = spark.read.parquet(f"{at}/pages.parquet").select("page_id", markup.html_text(("article", "main"))(F.col("html")).alias("x")).collect()
    words = lambda t: re.findall(r"\w+", t)
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        inside = re.sub(r"(?s)<(script|style|nav|aside|form|footer|header)\b.*?</\1>", " ", inside)
        want = set(words(html.unescape(re.sub(r"<[^>]*>", " ", inside))))
        assert len(want & set(words(r.x.text))) >= 0.9 * len(want)
