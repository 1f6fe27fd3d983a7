"""Near-duplicate line removal by an exact set-similarity self-join, DataFrame functions only.

A line is the set of its lower-case words. Each word becomes one 64-bit code whose high bits are the rank of
its rarity, so sorted codes stand in order of rarity. Two sets with a Jaccard
similarity of at least t share a code within their prefixes of n - ceil(t n) + 1 codes. Pairs that meet in a
code pass the length filter, the positional filter and a bound from 128-bit parity bitmaps before they are verified on the whole sets.

Lines in large groups of variants would meet in squares. So where lines of a length class share one of their rarest codes, each first meets
only the earliest of them, and the ones just before it; the likeliest of those are verified. What that settles no longer
asks, it only answers. The other lines then meet all earlier ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, row

_BITS = 17
#: Words are counted in so many buckets; a fixed size, so the table of ranks fits any driver.
BUCKETS = 1 << _BITS
_LAST = (1 << 63) - 1
#: White space within a line other than a space (fixed values).
_OTHER_SPACES = "\t\x0b\x0c\r"


@dataclass(frozen=True)
class LineConfig:
    similarity: float = 0.8
    #: Codes of each line under which it meets others in the first round.
    leader_codes: int = 4
    #: So many first lines, and one less of those just before it.
    leaders: int = 3
    #: So many of them, the likeliest, are verified.
    tried: int = 3


def _plain(text: Column) -> Column:
    """The text in lower case with a space for each character of white space within a line, so that lines split at one character."""
    odd = F.lit(False)
    for c in _OTHER_SPACES:
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.translate(text, _OTHER_SPACES, " " * len(_OTHER_SPACES))).otherwise(text))


def rarity_ranks(docs: DataFrame) -> Column:
    """An array with the rank of each bucket of words, the rarest first, from all words of ``docs``."""
    word = _lines(docs).select(F.explode(F.split("_text", " ")).alias("w")).where(F.col("w") != "")
    counted = word.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("b")).count()
    count = dict.fromkeys(range(BUCKETS), 0) | {r["b"]: r["count"] for r in counted.collect()}
    rank = {b: k for k, b in enumerate(sorted(count, key=lambda b: (count[b], b)))}
    return F.split(F.lit(",".join(str(rank[b] - BUCKETS // 2) for b in range(BUCKETS))), ",").cast("array<bigint>")


def _hashes(line: Column) -> Column:
    """The set of a line's words, as 64-bit hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _codes(line: Column, ranks: Column) -> Column:
    """The set of a line's words as sorted codes. The code is a bijection of the word's 64-bit hash. None is null, so plain numbers are sorted."""
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(_hashes(line), lambda h: F.shiftleft(rank(h), 64 - _BITS).bitwiseOR(F.shiftrightunsigned(h, _BITS))))


def _placed(docs: DataFrame) -> DataFrame:
    """(_doc, _th, text): the place of each document, and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_th"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line. (_doc, _th, _line) is its place; (_th, _line) tells its text, of which ``_text`` is the plain form."""
    return _placed(docs).select("_doc", "_th", F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("_line", "_text"))


def _needed(n: Column, t: float) -> Column:
    """ceil(t n) in whole numbers, where t has three decimals at most."""
    return F.floor((n * round(t * 1000) + 999) / 1000).cast("int")


def _enough(overlap: Column, both: Column, t: float) -> Column:
    """Whether sets of ``both`` words together can have a similarity of t with so many in common, in whole numbers."""
    k = round(t * 1000)
    return overlap * (1000 + k) >= both * k


def _plausible(a: str, b: str, t: float) -> Column:
    """Length filter and bitmap bound."""
    n, m = F.col(f"{a}.n").cast("bigint"), F.col(f"{b}.n").cast("bigint")
    return (F.least(n, m) * 1000 >= F.greatest(n, m) * round(t * 1000)) & _close(a, b, n + m, t)


def _close(a: str, b: str, both: Column, t: float) -> Column:
    """Bitmap bound: each bit in which the parities differ needs one code that one side lacks, so twice the overlap is at most the rest."""
    return _enough(both - _apart(a, b), both * 2, t)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))) + F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))


def _band(n: Column, t: float) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1 / t)).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, t: float, tag: str) -> DataFrame:
    """Of pairs (a, b) of ids in ``sets``, the ids b with a pair of similarity t or more, judged on the whole lines."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # lines are asked for by document, so only those that stand in a pair are taken out of their texts; a copy under another id is not asked
    places = sets.join(ids, "id", "left_semi").groupBy("_doc", "_th").agg(F.collect_list(F.struct("_line", "id")).alias("_asked"))
    texts = _placed(docs).join(places, ["_doc", "_th"]).select(F.split(_plain(F.col("text")), "\n", -1).alias("_split"), "_asked")
    asked = texts.select("_split", F.explode("_asked").alias("_at")).select("_at.id", F.get("_split", F.col("_at._line")).alias("_text"))
    codes = asked.dropDuplicates(["id"]).select("id", _hashes(F.col("_text")).alias("set"))
    codes = cut(codes, f"{tag}-sets")
    both = pairs.join(codes.select(F.col("id").alias("b"), F.col("set").alias("b_set")), "b").join(codes.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    k = round(t * 1000)
    found = cut(both.where(1000 * shared >= k * (F.size("a_set") + F.size("b_set") - shared)).select(F.col("b").alias("id")).distinct(), f"{tag}-found")
    drop_cut(codes)
    return found


def repeated_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(_doc, _th, removed): for each document with any, the indices of lines that an earlier line resembles."""
    t = config.similarity
    ranks = rarity_ranks(docs)
    codes = _lines(docs).where(F.ltrim("_text") != "").withColumn("c", _codes(F.col("_text"), ranks))
    n = F.size("c")

    def parity(half: int) -> Column:
        """64 of 128 bits: the parity of the number of codes that fall on each."""
        bits = F.array(*[F.lit((1 << (b & 63)) - (1 << 64) * (b & 63 == 63) if b >> 6 == half else 0).cast("bigint") for b in range(128)])
        return F.aggregate("c", F.lit(0).cast("bigint"), lambda x, c: x.bitwiseXOR(F.get(bits, c.bitwiseAND(127).cast("int"))))

    lines = cut(codes.select("_doc", "_th", "_line", F.xxhash64("c").alias("k1"), F.xxhash64(F.lit(1), "c").alias("k2"), n.alias("n"), parity(0).alias("low"), parity(1).alias("high"), F.slice("c", 1, n - _needed(n, t) + 1).alias("prefix")), "lines")
    # one row for each set; ids follow the order of the first line that has it
    sets = lines.groupBy("k1", "k2").agg(F.min(F.struct("_doc", "_th", "_line")).alias("at"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("prefix").alias("prefix"))
    sets = cut(sets.orderBy("at").select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "at._doc", "at._th", "at._line", "n", "low", "high", "prefix"), "line-sets")
    first = F.struct("l._doc", "l._th", "l._line") == F.struct("s._doc", "s._th", "s._line")
    slim = cut(lines.alias("l").join(sets.alias("s"), ["k1", "k2"]).select("l._doc", "l._th", "l._line", "s.id", first.alias("first")), "line-ids")
    drop_cut(lines)

    # first round: a few lines of the length class under each of the rarest codes; most of these codes have one line, which meets nobody
    order = Window.partitionBy("code", "band").orderBy("b.id")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = sets.select(F.struct("id", "n", "low", "high").alias("b"), _band(F.col("n"), t).alias("band"), F.explode(F.slice("prefix", 1, config.leader_codes)).alias("code"))
    shared = cut(rare.groupBy("code", "band").count().where(F.col("count") > 1).select("code", "band"), "shared-codes")
    met = rare.join(shared, ["code", "band"], "left_semi")
    others = [F.nth_value("b", k).over(w) for k in range(1, config.leaders + 1)] + [F.lag("b", k).over(order) for k in range(1, config.leaders)]
    met = met.select("b", *[x.alias(f"a{k}") for k, x in enumerate(others)])
    tried = [F.when((F.col(f"a{k}.id") < F.col("b.id")) & _plausible(f"a{k}", "b", t), F.struct(_apart(f"a{k}", "b").alias("apart"), F.col(f"a{k}.id").alias("id"))) for k in range(len(others))]
    best = met.select(F.col("b.id").alias("b"), F.least(*tried).alias("a")).where(F.col("a").isNotNull()).groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("a"))
    best = best.select("b", F.explode(F.slice("a", 1, config.tried)).alias("a")).select("b", "a.id").withColumnRenamed("id", "a")
    leaders = cut(best, "leader-pairs")
    settled = _verified(leaders, sets, docs, t, "leader")

    # second round: the others ask all earlier lines; what is settled only answers
    asked = sets.join(settled.withColumn("settled", F.lit(1)), "id", "left")
    packed = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("bigint"), 1)).bitwiseOR(F.col("ask"))
    rows = asked.select("id", "n", F.col("settled").isNull().cast("bigint").alias("ask"), "low", "high", F.posexplode(F.arrays_zip(F.col("prefix").alias("code"), F.concat(F.array(F.lit(None).cast("bigint")), "prefix").alias("before"))).alias("i", "c"))
    rows = rows.where(F.col("c.code").isNotNull()).select("c.code", "c.before", "id", "low", "high", packed.alias("p"))
    size = lambda x: F.shiftright(F.col(f"{x}.p"), 32)
    rest = lambda x: size(x) - F.shiftright(F.col(f"{x}.p").bitwiseAND(0xFFFFFFFF), 1)
    a, b = rows.alias("a"), rows.alias("b")
    short, long = F.least(size("a"), size("b")), F.greatest(size("a"), size("b"))
    both = size("a") + size("b")
    # the length filter is never met by a line that doesn't ask: this keeps the condition in the join, so that both sides share one exchange
    may = short * F.col("b.p").bitwiseAND(1) * 1000 >= long * round(t * 1000)
    # positional filter: from the first code that a pair shares, enough must be left of both lines
    meets = (F.col("a.code") == F.col("b.code")) & (F.col("a.id") < F.col("b.id")) & may & _enough(F.least(rest("a"), rest("b")), both, t) & _close("a", "b", both, t)
    # a pair that shares the code before as well has met there
    meets = meets & ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
    pairs = cut(a.join(b, meets).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "line-pairs")
    found = _verified(pairs, sets, docs, t, "line")
    drop_cut(sets)

    gone = slim.join(settled.union(found).withColumn("like", F.lit(True)), "id", "left").where(F.col("like").isNotNull() | ~F.col("first"))
    return gone.groupBy("_doc", "_th").agg(F.collect_set("_line").alias("removed"))


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, ``n_lines`` and ``n_removed``.

    A line goes if any earlier line (smaller doc_id, or the same text and smaller index; null ids come last) has a
    Jaccard similarity of at least ``similarity``, judged on the input. Lines without a word stay. A null text stays null with 0 lines.
    Rows with equal doc_id and text are one document in several rows and are treated alike; rows
    with one doc_id and different texts are ordered by a hash of the text. Other columns pass through, whatever their names, but for
    ``n_lines`` and ``n_removed``, which are replaced. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, config)
    mine = docs.select(row(docs), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_th"))
    split = mine.join(gone, ["_doc", "_th"], "left").withColumn("_split", F.split("_row.text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_split"), i)), "\n"))
    n_lines = F.coalesce(F.when(F.col("_split").isNotNull(), F.size("_split")), F.lit(0)).cast("long").alias("n_lines")
    n_removed = F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias("n_removed")
    columns = [kept.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return split.select(*columns, n_lines, n_removed)
