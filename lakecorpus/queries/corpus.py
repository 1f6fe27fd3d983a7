"""Queries of the corpus engine: metrics, gates, deduplication, mixtures, markup, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.functions import hashing as H
from lakecorpus.functions import markup
from lakecorpus.functions import metrics as M
from lakecorpus.functions import textnorm as N
from lakecorpus.operators import chunking, dedup, mixture, quality
from lakecorpus.plans import units
from lakecorpus.plans.clean import clean_corpus
from lakecorpus.sources import readers


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SP = N.SPACE
#: Parts of the SQL.
STRIPPED = f"regexp_replace(regexp_replace(text, '^[{SP}]+', ''), '[{SP}]+$', '')"
SQUASHED = f"regexp_replace(regexp_replace(regexp_replace(text, '[{SP}]+', ' ', 'g'), '^ ', ''), ' $', '')"
TOKENS = f"len(regexp_extract_all(text, '[{M.UNSPACED}]|[^{SP}{M.UNSPACED}]+'))"
VISIBLE = f"len(regexp_extract_all(text, '[^{SP}]'))"
SYMBOLS = f"len(regexp_extract_all(text, '[{M.SYMBOLS}]'))"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[{SP}]+', ''), '[{SP}]+$', '')), lambda x: x <> '')"
REPEATED = f"(CASE WHEN len({LINES}) > 0 THEN (len({LINES}) - len(list_distinct({LINES}))) / len({LINES}) ELSE 0.0 END)"
WORDS = rf"list_filter(regexp_extract_all(text, '[^{SP}]+'), lambda w: NOT regexp_matches(w, '[{M.UNSPACED}]') AND regexp_matches(w, '\p{{L}}'))"
WORD_LENGTH = f"(CASE WHEN len({WORDS}) >= 5 THEN length(array_to_string({WORDS}, '')) / len({WORDS}) END)"
SYMBOL_RATIO = f"(CASE WHEN {TOKENS} > 0 THEN {SYMBOLS} / {TOKENS} ELSE 1.0 END)"
FURNITURE = " OR ".join(f"contains(text, '{p}')" for p in quality.FURNITURE)
REASON = f"""CASE WHEN length({STRIPPED}) < 40 THEN 'too_short' WHEN {REPEATED} > 0.4 THEN 'repeated_lines' WHEN {SYMBOL_RATIO} > 0.5 THEN 'symbol_spam'
    WHEN {WORD_LENGTH} < 1.5 OR {WORD_LENGTH} > 40 THEN 'word_len' WHEN {FURNITURE} THEN 'boilerplate' ELSE '' END"""
PROXY = f"greatest(len(regexp_extract_all(text, '[^{SP}]+')), length(text) // 4, 1)"

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH j AS (SELECT doc_id, lang, {REASON} AS reason, sha1({SQUASHED}) AS k FROM documents),
f AS (SELECT k, min(doc_id) AS doc_id FROM j WHERE reason = '' GROUP BY k),
r AS (SELECT j.lang, CASE WHEN reason <> '' THEN reason WHEN f.doc_id IS NULL THEN 'duplicate' ELSE '' END AS reason FROM j LEFT JOIN f ON j.doc_id = f.doc_id)
SELECT lang, reason, count(*) AS n_docs FROM r GROUP BY ALL""")
def clean_documents(spark, sf_dir):
    return clean_corpus(docs(spark, sf_dir)).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT doc_id, {TOKENS} AS n_tokens, {REPEATED} AS repeated_lines, {SYMBOL_RATIO} AS symbol_ratio, {WORD_LENGTH} AS word_length, {PROXY} AS token_proxy FROM documents")
def doc_metrics(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", M.token_count(t).cast("long").alias("n_tokens"), M.repeated_line_fraction(t).alias("repeated_lines"), M.symbol_to_word_ratio(t).alias("symbol_ratio"), M.mean_word_length(t).alias("word_length"), M.token_proxy(t).alias("token_proxy"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[{M.SCRIPTS['latin']}]')) / {VISIBLE} AS latin, len(regexp_extract_all(text, '[{M.SCRIPTS['latin']}]')) / len(regexp_extract_all(text, '[^{SP}\p{{Nd}}]')) AS latin_no_digits, len(regexp_extract_all(text, '[0-9]')) / {VISIBLE} AS digits, 0.0 AS han FROM documents")
def script_ratios(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", M.script_ratio(t, "latin").alias("latin"), M.script_ratio_no_digits(t, "latin").alias("latin_no_digits"), M.digit_ratio(t).alias("digits"), M.script_ratio(t, "zh").alias("han"))


@query(f"WITH j AS (SELECT lang, {REASON} AS reason FROM documents), c AS (SELECT lang, reason, count(*) AS n_docs FROM j GROUP BY ALL) SELECT *, CAST(sum(n_docs) OVER (PARTITION BY lang) AS BIGINT) AS n_total FROM c")
def quality_reason_counts(spark, sf_dir):
    return quality.reason_counts(docs(spark, sf_dir).withColumn("reason", quality.quality_reason(F.col("text"))), "lang")


@query(f"WITH j AS (SELECT lang, source, {REASON} AS reason FROM documents) SELECT lang, source, reason, count(*) AS n_docs FROM j GROUP BY GROUPING SETS ((lang, reason), (source, reason))")
def quality_grouping_sets(spark, sf_dir):
    return quality.reason_counts_by_each(docs(spark, sf_dir).withColumn("reason", quality.quality_reason(F.col("text"))), "lang", "source")


COMPACT = f"regexp_replace(text, '[{SP}]+', '', 'g')"


def _grams(n: int) -> str:
    return f"list_transform(range(1, length({COMPACT}) - {n} + 2), lambda i: substring({COMPACT}, i, {n}))"


@query(f"""WITH t AS (SELECT doc_id, {COMPACT} AS c FROM documents), w AS (SELECT doc_id, c, length(c) AS n, unnest(range(1, length(c) - 1)) AS i FROM t),
d AS (SELECT doc_id, count(DISTINCT substring(c, i, 3)) AS kinds, max(n) - 2 AS total FROM w GROUP BY doc_id),
b AS (SELECT doc_id, c, unnest(range(1, length(c))) AS i FROM t), o AS (SELECT doc_id, substring(c, i, 2) AS g, count(*) AS k FROM b GROUP BY ALL), m AS (SELECT doc_id, max(k) AS k FROM o GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN length(c) > 3 THEN (total - kinds) / total ELSE 0.0 END AS dup_3grams, CASE WHEN length(c) > 2 THEN k * 2 / length(c) ELSE 0.0 END AS top_2gram
FROM t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN m ON t.doc_id = m.doc_id""")
def char_ngrams(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", M.ngram_shares(M.compact(F.col("text"))).alias("g"))
    return d.select("doc_id", F.col("g.repeated_3").alias("dup_3grams"), F.col("g.top_2").alias("top_2gram"))


#: The web gate on tables in Latin script: other script, no sentence rule, no compatibility form.
WEB = quality.WebConfig(script="latin", min_sentence_ends=0.0, max_top_2gram=0.10, max_dup_3grams=0.90, max_dup_4grams=0.75)


@query(f"""WITH n AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[{SP}]+', ' ', 'g'), '^ ', ''), ' $', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
t AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^[{SP}]+', ''), '[{SP}]+$', '') AS text FROM n), c AS (SELECT doc_id, text, {COMPACT} AS c FROM t),
g AS (SELECT doc_id, c, unnest(range(1, length(c) + 1)) AS i FROM c),
o AS (SELECT doc_id, count(DISTINCT CASE WHEN length(substring(c, i, 3)) = 3 THEN substring(c, i, 3) END) AS k3, count(DISTINCT CASE WHEN length(substring(c, i, 4)) = 4 THEN substring(c, i, 4) END) AS k4 FROM g GROUP BY doc_id),
b AS (SELECT doc_id, max(k) AS top FROM (SELECT doc_id, count(*) AS k FROM g WHERE i < length(c) GROUP BY doc_id, substring(c, i, 2)) GROUP BY doc_id),
r AS (SELECT c.doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 200 THEN 'too_short' WHEN len(regexp_extract_all(text, '[{M.SCRIPTS['latin']}]')) / {VISIBLE} < 0.55 THEN 'low_script'
 WHEN len(regexp_extract_all(text, '[0-9]')) / {VISIBLE} > 0.25 THEN 'digit_heavy' WHEN {REPEATED} > 0.30 THEN 'repeated_lines' WHEN top * 2 / length(c) > 0.10 THEN 'ngram_spam'
 WHEN (length(c) - 2 - k3) / (length(c) - 2) > 0.90 OR (length(c) - 3 - k4) / (length(c) - 3) > 0.75 THEN 'repetitive' ELSE '' END AS reason, length(text) AS n FROM c LEFT JOIN o ON c.doc_id = o.doc_id LEFT JOIN b ON c.doc_id = b.doc_id)
SELECT doc_id, reason, CASE WHEN reason = '' THEN n ELSE 0 END AS clean_chars FROM r""")
def web_gate(spark, sf_dir):
    return quality.web_gate(docs(spark, sf_dir), WEB, normalize=N.tidy_web).select("doc_id", "reason", F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("clean_chars"))


@query(f"""WITH gate AS ({QUERIES["web_gate"][1]}), k AS (SELECT reason, sha1({SQUASHED}) AS k FROM gate JOIN documents USING (doc_id)),
c AS (SELECT reason, count(*) AS n FROM k WHERE reason <> '' GROUP BY reason UNION ALL SELECT 'kept', count(DISTINCT k) FROM k WHERE reason = '' UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT k) FROM k WHERE reason = '')
SELECT reason, n FROM c WHERE n > 0""")
def web_units(spark, sf_dir):
    """The web job over the files of documents as its units, all in one commit, nothing written: documents by reason, repeats of kept texts as duplicates."""
    return units.clean_units(spark, [f"{sf_dir}/documents.parquet"], None, units.UnitJob(gate=WEB, normalize=N.tidy_web, near=False))


@query("SELECT doc_id, md5(text) AS m FROM documents")
def strip_furniture_lines(spark, sf_dir):
    stripped = quality.strip_furniture_lines(F.concat(F.lit("来源：test\n"), "text", F.lit("\n阅读原文")))
    return docs(spark, sf_dir).select("doc_id", F.md5(stripped.cast("binary")).alias("m"))


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


#: The steps of the line normalizer; an ornament repeated is spelled out, as patterns of SQL have no back references.
_RUNNING = _replaced(
    "line", (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{e000}-\x{f8ff}]", ""), (N.URL, " "), (N.EMAIL, " "), (r"[\t\r\f\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
    (N.LEADING_PAGE, ""), (N.PAGE_TOKEN, r" \1"), *[(f"[{c}]{{3,}}", c) for c in "★☆*#=_-—–·•|"], (" {2,}", " "), (f"^[{SP}]+|[{SP}]+$", ""),
)


@query(f"SELECT doc_id, k, {_RUNNING} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS k FROM documents)")
def running_lines(spark, sf_dir):
    """All lines of all texts through the line normalizer."""
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(N.lines(F.col("text"))).alias("k", "line"))
    return d.select("doc_id", "k", N.normalize_running_line(F.col("line")).alias("line"))


@query(f"""SELECT doc_id, CASE WHEN length(coalesce({STRIPPED}, '')) < 80 THEN 'too_short' ELSE 'script_impurity' END AS mongolian,
CASE WHEN length(coalesce(text, '')) < 120 THEN 'too_short' ELSE 'script_impurity' END AS legal FROM documents""")
def foreign_gates(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", quality.running_text_reason(t).alias("mongolian"), quality.bucket_reason(t, quality.BUCKETS["mn_cyrillic_legal"]).alias("legal"))


MONGOLIAN = "[\\x{1800}-\\x{18af}\\x{11660}-\\x{1167f}]"


#: Every second text with its small letters in the script, so that the gate has something to pass.
@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[a-z]', 'ᠮ', 'g') ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN length({STRIPPED}) < 80 THEN 'too_short' WHEN len(regexp_extract_all(text, '{MONGOLIAN}')) / {VISIBLE} < 0.55 THEN 'script_impurity' WHEN len(regexp_extract_all(text, '[A-Za-z]')) / {VISIBLE} > 0.20 THEN 'latin_noise'
WHEN {SYMBOL_RATIO} > 0.35 THEN 'symbol_spam' WHEN {REPEATED} > 0.25 THEN 'repeated_lines' ELSE '' END AS reason FROM t""")
def script_gate(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[a-z]", "ᠮ")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("text")).select("doc_id", quality.running_text_reason(F.col("text")).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN length(text) < 80 THEN 'too_short' WHEN len({LINES}) >= 4 AND {REPEATED} > 0.55 THEN 'repeated_lines' ELSE '' END AS code,
CASE WHEN length(text) < 80 THEN 'too_short' WHEN len({LINES}) >= 4 AND {REPEATED} > 0.55 THEN 'repeated_lines' WHEN {SYMBOLS} / {VISIBLE} > 0.12 THEN 'symbol_spam' ELSE '' END AS prose FROM documents""")
def bucket_gates(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", quality.bucket_reason(t, quality.BUCKETS["code"]).alias("code"), quality.bucket_reason(t, quality.BucketConfig("en", "prose")).alias("prose"))


@query(f"WITH k AS (SELECT doc_id, sha1({SQUASHED}) AS exact_key FROM documents) SELECT exact_key, min(doc_id) AS doc_id FROM k GROUP BY exact_key")
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(docs(spark, sf_dir)).select("exact_key", "doc_id")


@query(f"WITH k AS (SELECT doc_id, source, sha1({SQUASHED}) AS exact_key FROM documents) SELECT source, exact_key, min(doc_id) AS doc_id FROM k GROUP BY source, exact_key")
def dedup_per_bucket(spark, sf_dir):
    return dedup.exact_dedup(docs(spark, sf_dir), within=("source",)).select("source", "exact_key", "doc_id")


#: Some sources came in earlier runs.
@query(f"SELECT doc_id FROM (SELECT doc_id, sha1({SQUASHED}) AS k FROM documents WHERE source >= 'src15') WHERE k NOT IN (SELECT sha1({SQUASHED}) FROM documents WHERE source < 'src15')")
def dedup_against_state(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("exact_key", H.exact_key(F.col("text")))
    return dedup.not_seen(d.where("source >= 'src15'"), d.where("source < 'src15'")).select("doc_id")


SHINGLES = f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{SP}]+') AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS s FROM t)"


@query(f"{SHINGLES} SELECT doc_id, len(s) AS n_shingles, len(list_distinct(s)) AS n_distinct, sha1(array_to_string(s, '|')) AS digest FROM s")
def shingles4(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", H.shingles(M.tokens(F.col("text"))).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"), F.sha1(F.array_join("s", "|").cast("binary")).alias("digest"))


#: Votes on the 64 top bits of an MD5, which SQL has; near_pairs and near_dedup take a shorter hash that it lacks.
@query(f"""{SHINGLES}, u AS (SELECT doc_id, CAST('0x' || substr(md5(x), 1, 16) AS UBIGINT) AS h FROM (SELECT doc_id, unnest(s) AS x FROM s)), b AS (SELECT doc_id, h, unnest(range(64)) AS b FROM u),
v AS (SELECT doc_id, b, sum(CAST((h >> b::UBIGINT) & 1::UBIGINT AS INTEGER)) AS on_, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT doc_id, sum(CASE WHEN 2 * on_ > n THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << b::INTEGER END ELSE 0::HUGEINT END) AS sig FROM v GROUP BY doc_id)
SELECT doc_id, CAST(sig AS BIGINT) AS sig FROM w""")
def simhash_votes(spark, sf_dir):
    h = F.transform(H.shingles(M.tokens(F.col("text"))), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 16), 16, -10).cast("long"))
    d = docs(spark, sf_dir).select("doc_id", h.alias("h"))
    return d.select("doc_id", H.simhash_of_hashes(F.col("h")).alias("sig"))


@query()
def near_pairs(spark, sf_dir):
    return dedup.near_pairs(dedup.marked(docs(spark, sf_dir)).select("doc_id", "sig"))


@query()
def near_dedup(spark, sf_dir):
    return dedup.near_dedup(docs(spark, sf_dir)).select("doc_id", "exact_key", "sig")


@query()
def split_documents(spark, sf_dir):
    d = chunking.split_documents(docs(spark, sf_dir).select("doc_id", "text"), 1000, 1)
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("m"))


@query()
def chunk_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunk_words(M.tokens(F.col("text")), 60)).alias("k", "line"))


@query()
def html_text(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.html_text(("article", "main"))(F.col("html")).alias("x"))
    return p.select("page_id", F.length("x.text").cast("long").alias("n_chars"), F.md5(F.col("x.text").cast("binary")).alias("m"), F.col("x.title").alias("title"))


@query(f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[{SP}]+', ' ', 'g'), '^ ', ''), ' $', '') AS title FROM pages")
def html_title(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.html_title(F.col("html")).alias("title"))


MARKDOWN = "('# ' || text || chr(10) || '- *see* [a link](http://x.y/z) and ![no](i.png)' || chr(10) || '> `code` here' || chr(10) || '```' || chr(10) || 'gone' || chr(10) || '```')"


@query(r"""WITH t0 AS (SELECT doc_id, """ + MARKDOWN + r""" AS t FROM documents), t1 AS (SELECT doc_id, regexp_replace(t, '(?s)```.*?```', ' ', 'g') AS t FROM t0), t2 AS (SELECT doc_id, regexp_replace(t, '`([^`]+)`', '\1', 'g') AS t FROM t1),
t3 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS t FROM t2), t4 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s{0,3}#{1,6}\s*', '', 'g'), '(?m)^\s{0,3}[-*+]\s+', '', 'g'), '(?m)^\s{0,3}>\s?', '', 'g') AS t FROM t3),
t5 AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(t, '[ \t\r\f\x0b]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)) AS t FROM t4)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '\s+$|^\s+', '', 'g')) AS m FROM t5""")
def markdown_to_text(spark, sf_dir):
    raw = F.expr(MARKDOWN.replace("chr(10)", "'\\n'"))
    return docs(spark, sf_dir).select("doc_id", F.md5(markup.markdown_to_text(raw).cast("binary")).alias("m"))


MEASURE = f"""WITH t AS (SELECT lang, length(text) AS c, {PROXY} AS p, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
g AS (SELECT lang, count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN r <= 2000 THEN p ELSE 0 END) AS BIGINT) AS sample_tokens, CAST(sum(CASE WHEN r <= 2000 THEN c ELSE 0 END) AS BIGINT) AS sample_chars FROM t GROUP BY lang),
m AS (SELECT *, CAST(round_even(n_chars * (sample_tokens::DOUBLE / sample_chars), 0) AS BIGINT) AS est_tokens FROM g)"""
WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.3, "es": 0.1}
PLAN = MEASURE + f""", w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}) AS v(lang, weight)), j AS (SELECT m.*, weight FROM m JOIN w ON m.lang = w.lang),
x AS (SELECT *, weight / (SELECT sum(weight) FROM j) * (SELECT sum(est_tokens) FROM j)::DOUBLE AS target_tokens FROM j), y AS (SELECT *, least(target_tokens / est_tokens, 4.0::DOUBLE) AS repeat_factor FROM x)"""


@query(MEASURE + " SELECT * FROM m")
def mix_measure(spark, sf_dir):
    return mixture.measure(docs(spark, sf_dir), "lang")


def _plan(spark, sf_dir):
    weights = spark.createDataFrame(list(WEIGHTS.items()), "lang string, weight double")
    return mixture.plan(mixture.measure(docs(spark, sf_dir), "lang"), weights, "lang")


@query(PLAN + " SELECT lang, round(weight, 6) AS weight, round(target_tokens, 3) AS target_tokens, round(repeat_factor, 9) AS repeat_factor, round(CASE WHEN repeat_factor <= 1 THEN repeat_factor ELSE repeat_factor / ceil(repeat_factor) END, 9) AS emit_prob FROM y")
def mix_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("lang", F.round("weight", 6).alias("weight"), F.round("target_tokens", 3).alias("target_tokens"), F.round("repeat_factor", 9).alias("repeat_factor"), F.round("emit_prob", 9).alias("emit_prob"))


EMIT = PLAN + """, d AS (SELECT doc_id, text, d.lang, repeat_factor AS f, ('0x' || substr(md5('7|' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents d JOIN y ON d.lang = y.lang),
e AS (SELECT doc_id, text, lang, unnest(range(1, CAST(floor(f) + CASE WHEN u < f - floor(f) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM d)"""


@query(EMIT + " SELECT doc_id, lang, copy FROM e")
def mix_emit(spark, sf_dir):
    return mixture.emit(docs(spark, sf_dir), _plan(spark, sf_dir), "lang", seed=7).select("doc_id", "lang", F.col("copy").cast("long").alias("copy"))


@query(EMIT + f", r AS (SELECT lang, count(*) AS n_docs, CAST(sum({PROXY}) AS BIGINT) AS n_tokens FROM e GROUP BY lang) SELECT *, n_tokens / (SELECT sum(n_tokens) FROM r) AS share FROM r")
def mix_report(spark, sf_dir):
    return mixture.report(mixture.emit(docs(spark, sf_dir), _plan(spark, sf_dir), "lang", seed=7), "lang")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def interleave(spark, sf_dir):
    return mixture.interleave(docs(spark, sf_dir)).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


#: Documents one after the other: a full domain takes no document and no key.
@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT doc_id, substring(text, 1, 120) AS k, CASE WHEN contains(text, 'the') THEN 1 WHEN contains(text, 'les') THEN 2 WHEN contains(text, 'und') THEN 3 END AS d FROM documents) WHERE d IS NOT NULL),
s AS (SELECT 0::BIGINT AS r, [0, 0, 0] AS n, []::VARCHAR[] AS seen, NULL::BIGINT AS doc_id, NULL::INTEGER AS d, false AS took UNION ALL
SELECT r, CASE WHEN took THEN [n[1] + (d = 1)::INT, n[2] + (d = 2)::INT, n[3] + (d = 3)::INT] ELSE n END, CASE WHEN took THEN list_append(seen, md5(k)) ELSE seen END, doc_id, d, took FROM (
SELECT c.r, s.n, s.seen, c.doc_id, c.d, c.k, s.n[c.d] < 100 AND NOT list_contains(s.seen, md5(c.k)) AS took FROM s JOIN c ON c.r = s.r + 1))
SELECT doc_id, chr(96 + d) AS domain, CAST(n[d] AS BIGINT) AS rank FROM s WHERE took""")
def capped_seed(spark, sf_dir):
    domain = mixture.classify(F.col("text"), {"a": ("the",), "b": ("les",), "c": ("und",)})
    return mixture.capped_seed(docs(spark, sf_dir), domain, 100).select("doc_id", "domain", F.col("rank").cast("long").alias("rank"))


@query(f"WITH j AS (SELECT doc_id, {REASON} AS reason FROM documents) SELECT quality, reason, count(*) AS n_docs FROM labels JOIN j USING (doc_id) GROUP BY ALL")
def labels_by_reason(spark, sf_dir):
    judged = docs(spark, sf_dir).select("doc_id", quality.quality_reason(F.col("text")).alias("reason"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").join(judged, "doc_id").groupBy("quality", "reason").agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT doc_id, text AS line FROM (SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark) GROUP BY ALL")
def union_distinct(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(items).distinct().withColumnRenamed("text", "line")


VOCAB = f"(SELECT unnest(regexp_extract_all(text, '[^{SP}]+')) AS token FROM"


@query(f"SELECT DISTINCT token FROM {VOCAB} benchmark) EXCEPT SELECT token FROM {VOCAB} documents)")
def vocabulary_except(spark, sf_dir):
    words = lambda d: d.select(F.explode(M.tokens(F.col("text"))).alias("token"))
    return words(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).distinct().join(words(docs(spark, sf_dir)), "token", "left_anti")
