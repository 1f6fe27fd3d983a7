"""Queries of the reports, lookups, streams and tracks of tokens."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lakecorpus.functions import batches
from lakecorpus.functions import metrics as M
from lakecorpus.operators import gate, lookups, quality, reports, tokens, training_rows
from lakecorpus.streaming import ranks

from .corpus import PROXY, REASON, SP, docs

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"WITH j AS (SELECT lang, text, {REASON} AS reason FROM documents) SELECT lang, count(*) AS n_kept, CAST(sum(length(text)) AS BIGINT) AS kept_chars, CAST(sum(len(regexp_extract_all(text, '[{M.SCRIPTS['latin']}]'))) AS BIGINT) AS kept_script_chars FROM j WHERE reason = '' GROUP BY lang")
def kept_sizes(spark, sf_dir):
    judged = docs(spark, sf_dir).withColumn("reason", quality.quality_reason(F.col("text")))
    return reports.kept_sizes(judged, "latin", "lang")


@query(f"WITH t AS (SELECT lang, source, {PROXY} AS p FROM documents) SELECT lang, source, count(*) AS n_docs, CAST(sum(p) AS BIGINT) AS n_tokens, sum(p) / (SELECT sum(p) FROM t) AS share FROM t GROUP BY GROUPING SETS ((lang), (source))")
def share_rollup(spark, sf_dir):
    return reports.share_rollup(docs(spark, sf_dir), M.token_proxy(F.col("text")), "lang", "source")


#: Tokens of 5 characters, every seventh of them masked; spaces have no label.
@query("""WITH d AS (SELECT text FROM documents ORDER BY doc_id LIMIT 300), t AS (SELECT substring(text, i, 1) AS c, i FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM d))
SELECT (SELECT count(*) FROM d) AS n_rows, CAST(sum(CASE WHEN i % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, CAST(sum(CASE WHEN i % 7 <> 0 AND c <> ' ' THEN 1 ELSE 0 END) AS BIGINT) AS n_supervised,
sum(CASE WHEN i % 7 <> 0 AND c <> ' ' THEN 1 ELSE 0 END) / sum(CASE WHEN i % 7 <> 0 THEN 1 ELSE 0 END) AS supervised_rate FROM t""")
def supervision_sample(spark, sf_dir):
    chars = F.split("text", "")
    d = docs(spark, sf_dir).select("doc_id", chars.alias("c"))
    d = d.select("doc_id", F.transform("c", lambda c: F.when(c == " ", training_rows.IGNORE).otherwise(1)).alias("labels"), F.transform("c", lambda c, k: F.when((k + 1) % 7 == 0, 0).otherwise(1)).alias("mask"))
    return reports.supervision_sample(d, 300)


WORDS = rf"(SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^{SP}]+')) AS token FROM documents)"
KNOWN = rf"(SELECT DISTINCT unnest(regexp_extract_all(text, '[^{SP}]+')) AS token FROM benchmark)"


def _word_tokens(spark, sf_dir):
    """Words of documents with an id of 1 where the benchmark has them, else 0, and marks of words that begin with a digit."""
    words = M.tokens(F.col("text"))
    known = _read(spark, sf_dir, "benchmark").select(F.explode(words).alias("token")).distinct().withColumn("id", F.lit(1))
    t = docs(spark, sf_dir).select("doc_id", "lang", F.explode(words).alias("token"))
    return lookups.lookup(t, known, "token", "id", 0)


@query(f"""WITH t AS (SELECT w.*, k.token IS NULL AS unk FROM {WORDS} w LEFT JOIN {KNOWN} k ON w.token = k.token)
SELECT lang, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS n_chars, CAST(sum(unk::INT) AS BIGINT) AS n_unknown, CAST(sum(regexp_matches(token, '^[0-9]')::INT) AS BIGINT) AS n_byte,
sum(length(token)) / count(*) AS chars_per_token, sum(unk::INT) / count(*) AS unknown_rate, 1.0::DOUBLE - sum(unk::INT) / count(*) AS hit_rate, sum(regexp_matches(token, '^[0-9]')::INT) / count(*) AS byte_rate FROM t GROUP BY lang""")
def hit_rate(spark, sf_dir):
    t = _word_tokens(spark, sf_dir).select("lang", "id", F.lit(0).alias("start"), F.length("token").alias("end"), F.col("token").rlike("^[0-9]").alias("is_byte"))
    return reports.hit_rate(t, 0, "lang")


#: Each document is a span here: hit if the benchmark has all its words.
@query(f"""WITH t AS (SELECT w.*, k.token IS NULL AS unk FROM {WORDS} w LEFT JOIN {KNOWN} k ON w.token = k.token), d AS (SELECT doc_id, lang, count(*) AS n, bool_or(unk) AS unk FROM t GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(CASE WHEN unk THEN 0 ELSE n END) AS BIGINT) AS n_hit, sum(CASE WHEN unk THEN 0 ELSE n END) / sum(n) AS word_hit_rate FROM d GROUP BY lang""")
def word_hit_rate(spark, sf_dir):
    t = _word_tokens(spark, sf_dir).groupBy("doc_id", "lang").agg(F.collect_set("id").alias("ids"), F.array_join(F.collect_list("token"), " ").alias("text"))
    return reports.word_hit_rate(t, 0, "lang")


FOLDED = "lower(text)"


@query(f"SELECT lang, count(*) AS total, CAST(sum((text = {FOLDED})::INT) AS BIGINT) AS passed, CAST(sum((text <> {FOLDED})::INT) AS BIGINT) AS failed, sum((text = {FOLDED})::INT) / count(*) AS rate FROM documents GROUP BY lang")
def round_trip(spark, sf_dir):
    return reports.round_trip(docs(spark, sf_dir).select("lang", "text", F.lower("text").alias("decoded")), "lang")


@query(f"SELECT doc_id, md5(text) AS m, md5({FOLDED}) AS got FROM documents WHERE text <> {FOLDED} ORDER BY doc_id LIMIT 10")
def round_trip_failures(spark, sf_dir):
    d = reports.first_failures(docs(spark, sf_dir).select("doc_id", "text", F.lower("text").alias("decoded")))
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.md5(F.col("decoded").cast("binary")).alias("got"))


#: Offsets that follow from the length of words: some end before they start, some go back, some are none.
OFFSETS = "CASE WHEN length(token) % 5 = 0 THEN -1 ELSE k * 3 - (length(token) % 4) * 2 END AS s, CASE WHEN length(token) % 5 = 0 THEN -1 ELSE k * 3 + (length(token) % 3) - 2 END AS e"


@query(rf"""WITH w AS (SELECT doc_id, lang, length(text) AS n, unnest(regexp_extract_all(text, '[^{SP}]+')) AS token, unnest(range(len(regexp_extract_all(text, '[^{SP}]+')))) AS k FROM documents),
o AS (SELECT doc_id, lang, n, k, {OFFSETS} FROM w), r AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM o WHERE NOT (s = -1 AND e = -1))
SELECT lang, count(*) AS tokens_checked, CAST(sum((s < 0 OR e < s OR e > n)::INT) AS BIGINT) AS invalid_offsets, CAST(sum((s < coalesce(before, -1))::INT) AS BIGINT) AS non_monotonic FROM r GROUP BY lang""")
def offset_report(spark, sf_dir):
    def offsets(w, k):
        n, none = F.length(w), F.length(w) % 5 == 0
        return F.struct(F.when(none, -1).otherwise(k * 3 - (n % 4) * 2).alias("start"), F.when(none, -1).otherwise(k * 3 + (n % 3) - 2).alias("end"))

    d = docs(spark, sf_dir).select("lang", F.length("text").alias("n_chars"), F.transform(M.tokens(F.col("text")), offsets).alias("tokens"))
    return reports.offset_report(d, "lang")


#: Words as pieces of three letters, and a boundary behind each vowel inside a word.
@query(rf"""WITH w AS (SELECT lang, token, length(token) AS n FROM {WORDS}), b AS (SELECT *, list_filter(range(1, n), lambda i: contains('aeiou', substring(token, i, 1))) AS b FROM w)
SELECT lang, count(*) AS n_words, CAST(sum(len(b)) AS BIGINT) AS n_boundaries, CAST(sum(greatest(CAST(ceil(n / 3) AS BIGINT) - 1, 0)) AS BIGINT) AS n_token_boundaries, CAST(sum(len(list_filter(b, lambda i: i % 3 <> 0))) AS BIGINT) AS n_crossed,
(sum(len(b)) - sum(len(list_filter(b, lambda i: i % 3 <> 0)))) / sum(len(b)) AS respected_rate FROM b GROUP BY lang""")
def boundary_report(spark, sf_dir):
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.length(w) - 1, F.lit(3))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + 3, F.length(w)).alias("end")))
    inner = F.when(F.length(w) > 1, F.sequence(F.lit(1), F.length(w) - 1)).otherwise(F.array().cast("array<int>"))
    bounds = F.filter(inner, lambda i: F.substring(w, i, F.lit(1)).isin(*"aeiou"))
    d = docs(spark, sf_dir).select("lang", F.explode(M.tokens(F.col("text"))).alias("w"))
    return reports.boundary_report(d.select("lang", pieces.alias("tokens"), bounds.alias("boundaries")), "lang")


@query(f"""SELECT CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) AS BIGINT) AS char_tokens, CAST(sum({PROXY}) AS BIGINT) AS proxy_tokens, CAST(sum(length(hex(encode(text))) // 2) AS BIGINT) AS bytes_tokens,
1.0::DOUBLE AS char_chars_per_token, sum(length(text)) / sum({PROXY}) AS proxy_chars_per_token, sum(length(text)) / sum(length(hex(encode(text))) // 2) AS bytes_chars_per_token FROM documents""")
def compare_baselines(spark, sf_dir):
    d = docs(spark, sf_dir).select("text", M.token_proxy(F.col("text")).alias("proxy"), F.octet_length("text").alias("bytes"))
    return reports.compare_baselines(d, "proxy", "bytes")


@query(f"""WITH w AS (SELECT token, count(*) AS n FROM {WORDS} GROUP BY token), r AS (SELECT substring(token, 1, 4) AS root, sum(n) AS n FROM w WHERE least(length(token) / 8.0, 1) >= 0.6 GROUP BY root HAVING sum(n) >= 20)
SELECT root, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, root) AS rank FROM r""")
def root_dictionary(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(M.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    analyses = w.select(F.substring("token", 1, 4).alias("root"), F.least(F.length("token") / 8.0, F.lit(1.0)).alias("confidence"), "n")
    return reports.root_dictionary(analyses, 0.6, 20)


@query("WITH s AS (SELECT substring(text, 1, 8) AS surface, doc_id AS id FROM documents) SELECT surface, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM (SELECT DISTINCT * FROM s) GROUP BY surface HAVING count(*) > 1")
def shared_surfaces(spark, sf_dir):
    d = reports.shared_surfaces(docs(spark, sf_dir).select(F.substring("text", 1, 8).alias("surface"), F.col("doc_id").alias("id")))
    return d.select("surface", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT event_type, round(sum(value * (event_id % 50)) / sum(event_id % 50), 6) AS loss, CAST(sum(event_id % 50) AS BIGINT) AS n_tokens FROM events GROUP BY event_type")
def weighted_loss(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_type", F.col("value").alias("loss"), (F.col("event_id") % 50).alias("n_tokens"))
    return reports.weighted_loss(d, "event_type").withColumn("loss", F.round("loss", 6))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= greatest(1, 210 // (SELECT count(DISTINCT source) FROM documents))")
def per_file_budget(spark, sf_dir):
    return reports.per_file_budget(docs(spark, sf_dir).select("doc_id", "source"), 210, "source", "doc_id")


@query(f"""WITH w AS (SELECT lang, token, count(*) AS weight FROM {WORDS} GROUP BY ALL), c AS (SELECT *, sum(weight) OVER (PARTITION BY lang ORDER BY weight DESC, token ROWS UNBOUNDED PRECEDING) AS cumulative, sum(weight) OVER (PARTITION BY lang) AS total FROM w)
SELECT lang, token, weight, CAST(cumulative AS BIGINT) AS cumulative FROM c WHERE cumulative - weight < 0.9::DOUBLE * total""")
def nucleus(spark, sf_dir):
    w = docs(spark, sf_dir).select("lang", F.explode(M.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("weight"))
    return reports.nucleus(w, 0.9, "lang")


@query(f"SELECT lang, token, score, rank FROM (SELECT lang, token, count(*) AS score, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS rank FROM {WORDS} GROUP BY lang, token) WHERE rank <= 25")
def top_tokens(spark, sf_dir):
    w = docs(spark, sf_dir).select("lang", F.explode(M.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("score"))
    return reports.top_k(w, 25, "lang").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH w AS (SELECT token, count(*) AS n FROM {WORDS} GROUP BY token), p AS (SELECT token, n, unnest(range(1, length(token))) AS i FROM w), q AS (SELECT substring(token, i, 1) AS "left", substring(token, i + 1, 1) AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL)
SELECT * FROM q ORDER BY n DESC, "left", "right" LIMIT 1""")
def best_pair(spark, sf_dir):
    return reports.best_pair(tokens.pair_counts(tokens.word_counts(docs(spark, sf_dir))))


@query(f"SELECT token, n, kind FROM (SELECT k.token, count(w.token) AS n, CASE WHEN count(w.token) = 0 THEN 'zero' WHEN count(w.token) < 5 THEN 'rare' ELSE 'common' END AS kind FROM {KNOWN} k LEFT JOIN {WORDS} w ON k.token = w.token GROUP BY k.token) WHERE kind = 'common' ORDER BY n, token LIMIT 200")
def coverage_heads(spark, sf_dir):
    from lakecorpus.operators import evaluation

    words = M.tokens(F.col("text"))
    known = _read(spark, sf_dir, "benchmark").select(F.explode(words).alias("token")).distinct()
    return reports.coverage_heads(evaluation.vocabulary_coverage(known, evaluation.token_histogram(docs(spark, sf_dir), words)), "common")


CANDIDATES = "SELECT label AS word, vec_id % 7 AS score, vec_id % 3 AS depth, vec_id AS candidate FROM embeddings"


@query(f"SELECT word, candidate, score, depth FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, depth, candidate) AS r FROM ({CANDIDATES})) WHERE r = 1")
def best_candidate(spark, sf_dir):
    d = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("word"), (F.col("vec_id") % 7).alias("score"), (F.col("vec_id") % 3).alias("depth"), F.col("vec_id").alias("candidate"))
    return reports.best_candidate(d, "word")


@query(rf"""WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^{SP}]+')) AS keys FROM documents)
SELECT doc_id, len(list_filter(['the', 'a', 'of'], lambda x: NOT list_contains(keys, x))) AS n_missing, len(list_filter(keys, lambda x: x NOT IN ('the', 'a', 'of', 'and'))) AS n_unknown FROM k""")
def key_checks(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.array_distinct(M.tokens(F.col("text"))).alias("keys"))
    return d.select("doc_id", F.size(reports.missing_keys(d, ("the", "a", "of"))).cast("long").alias("n_missing"), F.size(reports.unknown_keys(("the", "a", "of"), ("and",))).cast("long").alias("n_unknown"))


@query("SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer")
def split_overlap(spark, sf_dir):
    return reports.overlap(_read(spark, sf_dir, "events").select("user_id"), _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


#: Image files by source, with label files of two kinds for some.
@query("""WITH i AS (SELECT doc_id, source || '/' || doc_id || '.png' AS path FROM documents), l AS (SELECT source || '/' || doc_id || '.txt' AS path, lang AS label, 2 AS place, source || '/' || doc_id || '.png' AS image FROM documents WHERE doc_id % 3 <> 0
 UNION ALL SELECT source || '/' || doc_id || '.json', source, 1, source || '/' || doc_id || '.png' FROM documents WHERE doc_id % 4 = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY place, path) AS r FROM l) WHERE r = 1)
SELECT i.doc_id, i.path, b.path AS label_path, b.label FROM i LEFT JOIN b ON i.path = b.image""")
def image_sidecars(spark, sf_dir):
    d = docs(spark, sf_dir)
    name = lambda s: F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(s))
    labels = d.where("doc_id % 3 <> 0").select(name(".txt").alias("path"), F.col("lang").alias("label")).union(d.where("doc_id % 4 = 0").select(name(".json"), "source"))
    labels = labels.union(d.select(name(".bak"), F.lit("no sidecar")))
    return lookups.with_sidecars(d.select("doc_id", name(".png").alias("path")), labels)


@query(f"""WITH l AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS local_id FROM {KNOWN}), v AS (SELECT token, local_id * 2 + 256 AS id FROM l WHERE local_id % 5 <> 0), t AS (SELECT doc_id, (doc_id * 31) % 700 AS local_id FROM documents)
SELECT doc_id, t.local_id, CAST(coalesce(v.id, 1) AS BIGINT) AS global_id FROM t LEFT JOIN l ON t.local_id = l.local_id LEFT JOIN v ON l.token = v.token""")
def global_ids(spark, sf_dir):
    known = _read(spark, sf_dir, "benchmark").select(F.explode(M.tokens(F.col("text"))).alias("token")).distinct()
    local = reports.ranked(known, F.col("token")).select("token", (F.col("rank") - 1).alias("local_id"))
    vocabulary = local.where("local_id % 5 <> 0").select("token", (F.col("local_id") * 2 + 256).alias("id"))
    t = docs(spark, sf_dir).select("doc_id", ((F.col("doc_id") * 31) % 700).alias("local_id"))
    return lookups.to_global(t, local, vocabulary, 1).select("doc_id", "local_id", F.col("global_id").cast("long").alias("global_id"))


@query(f"SELECT token AS word, CASE token WHEN 'the' THEN 'THE' WHEN 'und' THEN 'UND' ELSE token END AS spelling FROM (SELECT DISTINCT token FROM {WORDS})")
def fixed_words(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(M.tokens(F.col("text"))).alias("word")).distinct()
    return lookups.fixed_words(words, spark.createDataFrame([("the", "THE"), ("und", "UND")], "word string, spelling string"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 20 END AS min_chars, lang IN ('en', 'fr') AS known FROM documents")
def bucket_configs(spark, sf_dir):
    configs = spark.createDataFrame([("en", 10), ("fr", 20)], "lang string, min_chars int")
    return lookups.with_config(docs(spark, sf_dir).select("doc_id", "lang"), configs, "lang").select("doc_id", "lang", "min_chars", "known")


@query("SELECT d.doc_id, quality, length(text) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def aligned_rows(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    mine = docs(spark, sf_dir).join(labels, "doc_id", "left_semi").select("doc_id", F.length("text").alias("n"))
    return lookups.aligned(labels, mine, "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_done(spark, sf_dir):
    return lookups.not_done(_read(spark, sf_dir, "orders").select("o_orderkey"), _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


#: Characters as ids: a space opens a word, a vowel e is a morpheme boundary, other signs are special.
CODE = "CASE WHEN c = ' ' THEN 17 WHEN c = 'e' THEN 18 WHEN NOT regexp_matches(c, '[A-Za-z]') THEN 5 ELSE 300 END"


@query(f"""WITH t AS (SELECT doc_id, i - 1 AS pos, {CODE} AS id FROM (SELECT doc_id, i, substring(text, i, 1) AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents))),
a AS (SELECT *, sum((id = 17)::INT) OVER w AS words, sum((id IN (5, 17))::INT) OVER w AS run, max((id = 300 AND NOT opened)::INT) OVER w AS early FROM (SELECT *, coalesce(bool_or(id = 17) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS opened FROM t) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, sum(CASE WHEN id = 18 AND NOT (words = 0 AND early = 0) THEN 1 ELSE 0 END) OVER r AS counted, sum((id = 18)::INT) OVER r AS everything FROM a WINDOW r AS (PARTITION BY doc_id, run ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(sum(greatest(words - 1 + early, 0) * (pos % 97)) AS BIGINT) AS word_sum, CAST(sum(CASE WHEN id IN (5, 17) THEN 0 ELSE least(CASE WHEN words = 0 AND early = 0 THEN everything ELSE CASE WHEN words = 0 THEN counted ELSE everything END END, 3) END * (pos % 89)) AS BIGINT) AS depth_sum FROM b GROUP BY doc_id""")
def boundary_positions(spark, sf_dir):
    known = dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 300) | {" ": 17, "e": 18}
    d = docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", tokens.character_ids(F.col("text"), known, 5).alias("ids"))
    d = d.select("doc_id", training_rows.boundary_tracks(F.col("ids"), 17, 18, max_depth=4).alias("p"))
    return d.select("doc_id", _place_sums(97)(F.col("p.word_pos")).alias("word_sum"), _place_sums(89)(F.col("p.morph_depth")).alias("depth_sum"))


def _place_sums(m: int):
    """The sum of a list's values, each times its place modulo m."""

    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        at, flat = batches.list_places(lists)
        sums = np.zeros(len(lists), dtype=np.int64)
        for a, b in batches.parts(lists):
            low, high = int(at[a]), int(at[b])
            place = np.arange(low, high) - np.repeat(at[a:b], np.diff(at[a : b + 1]))
            total = np.r_[0, np.cumsum(flat.slice(low, high - low).to_numpy(zero_copy_only=False) * (place % m))]
            sums[a:b] = np.diff(total[at[a : b + 1] - low])
        return pa.array(sums)

    return run


#: Words and white space as tokens with their true offsets, less every fourth: a word goes on where nothing is left out.
@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{SP}]+|[{SP}]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^{SP}]+|[{SP}]+')))) AS pos FROM documents), o AS (SELECT *, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM t),
k AS (SELECT doc_id, pos, e - length(w) AS s, e, pos % 9 = 5 AS none FROM o WHERE pos % 4 <> 3), n AS (SELECT *, NOT none AND (lag(none) OVER w IS NULL OR lag(none) OVER w OR lag(e) OVER w <> s) AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, sum(new::INT) OVER w AS words, max(CASE WHEN new THEN pos END) OVER w AS since FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, pos, CAST(greatest(words - 1, 0) AS INTEGER) AS word_pos, CAST(CASE WHEN none THEN 0 ELSE pos - since END AS INTEGER) AS morph_depth FROM c""")
def offset_positions(spark, sf_dir):
    parts = F.regexp_extract_all("text", F.lit(f"[^{SP}]+|[{SP}]+"), F.lit(0))
    t = docs(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("pos", "w"))
    t = t.withColumn("e", F.sum(F.length("w")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("pos % 4 <> 3")
    none = F.col("pos") % 9 == 5
    t = t.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(none, -1).otherwise(F.col("e") - F.length("w")).alias("start"), F.when(none, -1).otherwise(F.col("e")).alias("end"))
    return training_rows.positions_from_offsets(t).select("doc_id", "pos", "word_pos", "morph_depth")


#: Bytes of a text with spans of ten from each multiple of 40; a row is cut to 95 tokens, in front of the span from 90... or 80.
@query("""WITH d AS (SELECT doc_id, length(hex(encode(text))) // 2 AS n, 60 + doc_id % 60 AS lim FROM documents), c AS (SELECT *, CASE WHEN n <= 95 THEN n WHEN doc_id % 2 = 0 THEN 90 ELSE 95 END AS cut FROM d)
SELECT doc_id, cut AS n_ids, n > 95 AS truncated, CAST(CASE WHEN doc_id % 2 = 0 THEN (10 <= cut)::INT + (60 <= cut)::INT + (100 <= cut)::INT ELSE (10 <= cut)::INT + (60 <= cut)::INT END AS BIGINT) AS n_spans FROM c""")
def span_truncation(spark, sf_dir):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    ids = training_rows.byte_ids(F.col("text"))
    spans = F.when(F.col("doc_id") % 2 == 0, F.array(span(0, 10), span(50, 60), span(90, 100))).otherwise(F.array(span(0, 10), span(50, 60)))
    whole = F.filter(spans, lambda s: (s["end"] <= F.size("ids")) | (s["start"] < 95))
    d = docs(spark, sf_dir).select("doc_id", ids.alias("ids")).withColumn("labels", F.col("ids")).withColumn("spans", whole)
    d = training_rows.truncate_spans(d, 95)
    fits = F.size(F.filter("spans", lambda s: s["end"] <= F.size("ids")))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "truncated", fits.cast("long").alias("n_spans"))


#: Texts as rows of at most 200 bytes.
@query("SELECT doc_id, least(length(hex(encode(text))) // 2, 200) AS n, CAST(least(length(hex(encode(text))) // 2, 200) * (least(length(hex(encode(text))) // 2, 200) - 1) // 2 AS BIGINT) AS positions, 0::BIGINT AS depths FROM documents")
def normalized_rows(spark, sf_dir):
    d = training_rows.normalize_rows(docs(spark, sf_dir).select("doc_id", training_rows.byte_ids(F.col("text")).alias("ids"), F.lit(False).alias("has_media")), 200)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size("mask").cast("long").alias("n"), total("word_pos").alias("positions"), total("morph_depth").alias("depths"))


@query("""WITH d AS (SELECT doc_id, doc_id // 8 AS batch, lower(hex(encode(text))) AS h FROM documents), m AS (SELECT batch, CAST(max(length(h)) AS INTEGER) AS longest FROM d GROUP BY batch),
r AS (SELECT batch, doc_id, longest, h, array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: CASE WHEN x = '0a' THEN 'zz' ELSE x END), '') AS l FROM d JOIN m USING (batch))
SELECT batch, count(*) AS n_rows, CAST(sum(longest) // 2 AS BIGINT) AS n_cells, CAST(sum(longest - length(h)) // 2 AS BIGINT) AS n_padding, md5(string_agg(rpad(h, longest, '-'), '' ORDER BY doc_id)) AS ids,
 md5(string_agg(rpad(l, longest, 'z'), '' ORDER BY doc_id)) AS labels FROM r GROUP BY batch""")
def collated(spark, sf_dir):
    """Batches of eight texts as byte ids, padded to the longest of each; line feeds aren't learned from."""
    d = docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), training_rows.byte_ids(F.col("text")).alias("ids"))
    d = d.withColumn("labels", training_rows.labels(F.col("ids"), F.array(F.lit(10))))
    return training_rows.collate(d, "batch", 256, take=_told, taken=_TOLD)


_TOLD = StructType([StructField(n, StringType() if n in ("ids", "labels") else LongType()) for n in ("batch", "n_rows", "n_cells", "n_padding", "ids", "labels")])


def _told(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sizes and digests of one padded batch. Null rows are counted, and have no cells."""
    ids, labels, mask = (batch.column(c).flatten() for c in ("ids", "labels", "mask"))
    real = len(ids) - ids.null_count
    longest = pc.max(pc.list_value_length(ids)).as_py()
    md5 = lambda x, marks: hashlib.md5(training_rows.hex_pairs(marks)(x.flatten().to_numpy()).tobytes()).hexdigest() if real else None
    cells = None if longest is None else longest * len(ids)
    padding = None if longest is None else longest * real - int(mask.flatten().to_numpy().sum())
    row = [batch.column("batch")[0].as_py(), len(ids), cells, padding, md5(ids, {256: "--"}), md5(labels, {training_rows.IGNORE: "zz"})]
    return pa.RecordBatch.from_arrays([pa.array([x], type=pa.string() if isinstance(f.dataType, StringType) else pa.int64()) for x, f in zip(row, _TOLD, strict=True)], names=_TOLD.names)


@query("""WITH f AS (SELECT source AS path, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)) SELECT path, CAST(i % 4 AS INTEGER) AS rank, CAST((i // 4) % 2 AS INTEGER) AS worker FROM f""")
def dealt_files(spark, sf_dir):
    return ranks.deal_files(docs(spark, sf_dir).select(F.col("source").alias("path")), 4, 2)


#: Two epochs in batches of 16, resumed after three steps of two batches.
@query("""WITH e AS (SELECT doc_id, lang, epoch, ('0x' || substr(md5('5|0|' || epoch || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM documents, (SELECT unnest(range(2)) AS epoch)),
b AS (SELECT doc_id, lang, epoch, (row_number() OVER (PARTITION BY lang ORDER BY epoch, draw, doc_id) - 1) // 16 AS batch FROM e) SELECT doc_id, lang, CAST(epoch AS INTEGER) AS epoch, batch FROM b WHERE batch >= 6""")
def resumed_epochs(spark, sf_dir):
    drawn = ranks.epochs(docs(spark, sf_dir).select("doc_id", "lang"), 2, 5)
    return ranks.resume(ranks.batches(drawn, 16, ("lang",)), 3, 2).select("doc_id", "lang", "epoch", "batch")


#: Words of one document in three with letters of the traditional script between them, so that both tracks have work.
MIXED = "regexp_replace(text, '(the|der|les|que)', 'ᠮᠣᠩᠭᠣᠯ', 'g')"
_LETTERS = "ᠮᠣᠩᠭᠯ"


def _dual(path: str):
    """A tokenizer of both tracks: letters of the script with two merges, and the byte-level vocabulary of a file that every executor has."""
    from lakecorpus.operators import dual

    general = dual.General(path)
    pieces = {t: k for k, t in enumerate(["<unk>", *_LETTERS, "ᠮᠣ", "ᠮᠣᠩ"])}
    segment = (24576, 131072)
    vocabulary = dual.unified(pieces, general.vocabulary, (300, 24576), segment)
    return dual.DualTokenizer(vocabulary, dual.Pieces(pieces, {("ᠮ", "ᠣ"): 0, ("ᠮᠣ", "ᠩ"): 1}), general, segment)


def _mixed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", F.regexp_replace("text", "(the|der|les|que)", "ᠮᠣᠩᠭᠣᠯ").alias("text"))


#: Each word of the script is ᠮᠣᠩ and three letters; spaces are one token each; all texts come back.
@query(f"SELECT doc_id, 4 * len(regexp_extract_all(t, 'ᠮᠣᠩᠭᠣᠯ')) AS n_mn, len(regexp_extract_all(t, ' ')) AS n_space, CAST(length(t) AS BIGINT) AS n_covered, md5(t) AS m FROM (SELECT doc_id, {MIXED} AS t FROM documents)")
def dual_tokens(spark, sf_dir):
    import public_tokenizers

    from lakecorpus.operators import dual

    make = functools.partial(_dual, public_tokenizers.path("byte_bpe_50k.json"))

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Texts are encoded, counted and decoded in the part that they come in: no token leaves the task. Of a null text nothing is known."""
        tokenizer = dual.made(make)
        texts = batch.column("text")
        t = tokenizer.encode_texts([x or "" for x in texts.to_pylist()])
        back = tokenizer.decode_lists(t.at, t.ids)
        of = lambda track: np.diff(np.r_[0, np.cumsum(t.tracks == dual.TRACKS.index(track), dtype=np.int64)][t.at])
        # a character of several bytes may lie in several tokens: what is covered is counted from each token's end
        covered, some = np.zeros(len(texts), dtype=np.int64), np.diff(t.at) > 0
        covered[some] = np.maximum(np.maximum.reduceat(t.ends, t.at[:-1][some]), 0) if some.any() else 0
        none = texts.is_null().to_numpy(zero_copy_only=False)
        md5 = pa.array([hashlib.md5(x.encode()).hexdigest() for x in back], type=pa.string(), mask=none)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, mask=none) for x in (of("mn"), of("space"), covered)), md5], names=["doc_id", *counts, "m"])

    counts = ("n_mn", "n_space", "n_covered")
    d = _mixed(spark, sf_dir).select("doc_id", "text")
    return batches.in_parts(d, told, StructType([d.schema["doc_id"], *[StructField(c, LongType()) for c in counts], StructField("m", StringType())]))


#: Bytes of texts as rows with faults that follow from their ids: an id or label out of range, offsets beyond the text, a missing depth, a negative position.
@query("""WITH d AS (SELECT doc_id, length(hex(encode(text))) // 2 AS n, len(list_filter(range(0, length(hex(encode(text))) // 2), lambda i: i % 50 = 7)) AS k FROM documents), f AS (
SELECT doc_id, 'id_range' AS rule, 1 AS n FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'label_range', 1 FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'offset', k FROM d WHERE doc_id % 7 = 0 AND k > 0
UNION ALL SELECT doc_id, 'morph_depth_length', 1 FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'negative_word_pos', n FROM d WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'images_count', 1 FROM d WHERE doc_id % 13 = 0)
SELECT rule, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_failures FROM f GROUP BY rule""")
def gate_failures(spark, sf_dir):
    k = F.col("doc_id")
    ids = training_rows.byte_ids(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.transform(ids, lambda x, i: F.when((i == 0) & (k % 5 == 0), 999).otherwise(x)).alias("ids"))
    far = lambda x, i: F.struct(F.lit(0).alias("start"), F.when((k % 7 == 0) & (i % 50 == 7), 1 << 30).otherwise(0).alias("end"))
    d = d.withColumns({"labels": F.col("ids"), "offsets": F.transform("ids", far), "word_pos": F.transform("ids", lambda x: F.when(k % 11 == 0, -1).otherwise(0))})
    depths = F.transform("ids", lambda x: F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")
    d = d.withColumns({"morph_depth": F.when(k % 3 == 0, F.slice(depths, F.lit(2), F.size("ids"))).otherwise(depths), "spans": none, "images": F.when(k % 13 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    return gate.failure_counts(gate.failures(d, 300, n_chars="n_chars", media={"spans": ("images", 1, 2)}))


@query("""SELECT doc_id, md5(rtrim(translate(CASE WHEN contains(text, 'q') THEN split_part(text, 'q', 1) ELSE text END, 'e', ''), '')) AS m FROM documents""")
def continuations(spark, sf_dir):
    """Characters as ids: q ends a text, e is padding."""
    d = docs(spark, sf_dir).select("doc_id", F.transform(F.split("text", ""), lambda c: F.when(c == "q", 0).when(c == "e", 1).otherwise(2)).alias("kind"), F.split("text", "").alias("c"))
    end = F.when(F.array_position("kind", 0) > 0, F.array_position("kind", 0) - 1).otherwise(F.size("c")).cast("int")
    kept = F.size(gate.continuation(F.col("kind"), 0, 1))
    text = F.array_join(F.filter(F.slice("c", F.lit(1), end), lambda c: c != "e"), "")
    same = F.when(kept == F.length(text), text).otherwise(F.raise_error(F.lit("lengths differ")).cast("string"))
    return d.select("doc_id", F.md5(same.cast("binary")).alias("m"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'text' END AS type, source, 2::INTEGER AS n_keys FROM documents")
def metadata_keys(spark, sf_dir):
    always = F.create_map(F.lit("source"), F.col("source"), F.lit("other"), F.lit("gone"))
    typed = F.map_concat(always, F.create_map(F.lit("type"), F.col("lang")))
    m = gate.metadata(F.when(F.col("doc_id") % 3 == 0, typed).otherwise(always))
    return docs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", F.col("m")["type"].alias("type"), F.col("m")["source"].alias("source"), F.size("m").alias("n_keys"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def json_numbers(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("-inf")).otherwise(F.col("value"))
    return _read(spark, sf_dir, "events").select("event_id", gate.json_number(v).alias("value"))


@query("SELECT lang, count(*) AS n_rows, CAST(sum((doc_id % 6 = 0 OR length(text) = 0)::INT) AS BIGINT) AS n_empty FROM documents GROUP BY lang")
def empty_counts(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<int>")).otherwise(training_rows.byte_ids(F.col("text")))
    return gate.filled(docs(spark, sf_dir).select("lang", ids.alias("ids")), "lang")[1]
