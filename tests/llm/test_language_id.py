from collections import Counter

import regex
from lakecorpus.llm import language_id as li
from pyspark.sql import functions as F


def brute_rank(counts, size):
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:size])}


def grams(text, longest=5):
    out = Counter()
    for w in regex.findall(r"\p{L}{1,40}", text.lower()):
        w = f"_{w}_"
        for n in range(1, longest + 1):
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def test_profiles_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    config = li.ProfileConfig(profile_size=50)
    want, counts = {}, {}
    for r in docs.collect():
        counts.setdefault(r.lang, Counter()).update(grams(r.text))
    for lang, c in counts.items():
        want |= {(lang, g): k for g, k in brute_rank(c, 50).items()}
    got = {(r.lang, r.gram): r["rank"] for r in li.train_profiles(docs, config).collect()}
    assert got == want


def test_distance_is_out_of_place():
    rows = [("aa", g, k) for k, g in enumerate(["_", "a", "b", "_a", "ab"])] + [("bb", g, k) for k, g in enumerate(["b", "_", "c"])]
    config = li.ProfileConfig(profile_size=5, document_size=100)
    model = li.Profiles(rows, config)
    # all n-grams of the one word have count 1 but "_": their order is that of their keys, so only a profile's own n-grams and "_" are certain
    langs, scores = model.predict(["ab", None, "123 !!", "ab ab"])
    assert langs == ["aa", "und", "und", "aa"] and scores[1] == scores[2] == 0.0 and 0 < scores[0] < 1
    assert li.Profiles([], config).predict(["ab"]) == (["und"], [0.0])


def test_predictions_equal_brute_force(spark):
    """The out-of-place distance of each text to each profile, summed one n-gram at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    config = li.ProfileConfig(profile_size=60, document_size=40)
    profiles = {}
    rows = [(r.lang, r.gram, r["rank"]) for r in li.train_profiles(docs, config).collect()]
    for lang, g, k in rows:
        profiles.setdefault(lang, {})[g] = k
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect()]
    got = li.Profiles(rows, config).predict(texts)
    for text, lang, score in zip(texts, *got, strict=True):
        counts = grams(text)
        names = list(counts)
        key = dict(zip(names, (int(x) for x in li._gram_keys(names, config.longest)), strict=True))
        mine = sorted(names, key=lambda g: (-counts[g], (key[g] & ((1 << 56) - 1)) >> 24))[: config.document_size]
        apart = {x: sum(min(abs(p[g] - k), config.profile_size) if g in p else config.profile_size for k, g in enumerate(mine)) for x, p in profiles.items()}
        best = min(sorted(apart), key=lambda x: apart[x])
        assert lang == best and abs(score - (1 - apart[best] / (len(mine) * config.profile_size))) < 1e-12


def test_held_out_accuracy(spark):
    from lakecorpus.llm.queries import queries

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = queries()["op1_language_id"](spark, at)
    assert rows.count() == docs.count()
    out = rows.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert out.a > 0.97 and 0 <= out.lo <= out.hi <= 1


def test_held_out_third(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(300).select("id", li.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}


def test_odd_rows(odd_docs):
    profiles = li.train_profiles(odd_docs)
    rows = li.identify(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 6, 7)} == {"und"}
    assert li.identify(odd_docs.limit(0), profiles).count() == 0
    assert li.train_profiles(odd_docs.limit(0)).count() == 0
