"""Quality gates: each adds a reason, the first rule that a text fails, or '' if it passes all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecorpus.functions import metrics as M
from lakecorpus.functions import textnorm as N

#: Strings of page furniture and of error pages (fixed values).
FURNITURE = ("京ICP备", "蒙ICP备", "版权所有", "All Rights Reserved", "未经授权")
ERROR_PAGES = ("Object not found!", "The requested URL was not found on this server", "Just a moment...", "Access denied", "Enable JavaScript and cookies")
#: Lines of page furniture, and promotions (fixed values).
FURNITURE_LINES = (
    r"^.{0,12}声明[:：]", r"免责声明", r"版权所有", r"All Rights Reserved", r"未经.{0,6}(授权|许可|书面同意)", r"如遇作品内容.{0,4}版权",
    r"本(文|站|网|公众号).{0,8}(转载|来源|版权)", r"^责任编辑[:：]", r"^编辑[:：]", r"^来源[:：].{0,40}$", r"^记者[:：].{0,30}$",
    r"^(上一篇|下一篇|相关(阅读|推荐|新闻|链接))", r"(我要|发表|查看更多)?评论\s*\(?\d*\)?$", r"(扫一扫|扫码).{0,12}(关注|下载|分享|二维码)",
    r"关注.{0,6}(公众号|微信|视频号)", r"微信(公众号|号)[:：]", r"阅读原文", r"分享到[:：]?", r"^(打印|收藏|点赞|转发|返回(顶部|列表))$", r"网站地图",
    r"^字号[:：]", r"^\s*play\s+stop\s+mute", r"^(客服|投诉|举报|咨询|联系)?(热线|电话)[:：]", r"京ICP备|蒙ICP备|粤ICP备|沪ICP备|ICP备\d", r"公网安备",
)
SOLICITATION = r"(代开|代办|出售|批发|收购|转让|办证|代孕|刷单|套现|网赚|私聊|微商|薇商|包邮购)"
CONTACT = r"(微信|薇信|徽信|威信|QQ|扣扣|vx|VX|Vx|whatsapp|telegram|纸飞机)\s*[:：]?\s*[0-9A-Za-z][0-9A-Za-z\- ]{4,}"
GAMBLING = r"(六合彩|时时彩|私彩|百家乐|博彩|赌场|赌博|娱乐城|彩金|外围|菠菜平台).{0,12}(网址|平台|注册|开户|代理|官网|送|app|APP)"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, or ''. A rule that is null doesn't hold."""
    out = None
    for name, failed in rules:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise("")


@dataclass(frozen=True)
class QualityConfig:
    """Limits of the general gate (fixed values)."""

    min_chars: int = 40
    script: str = ""
    min_script_ratio: float = 0.5
    max_repeated_lines: float = 0.4
    max_symbols: float = 0.5
    min_word_length: float = 1.5
    max_word_length: float = 40.0
    furniture: tuple[str, ...] = FURNITURE


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def quality_reason(text: Column, config: QualityConfig = QualityConfig()) -> Column:
    """The general gate. Null is empty; rules follow in a fixed order."""
    t = F.coalesce(text, F.lit(""))
    rules = [("too_short", M.text_counts(t)["n_stripped"] < config.min_chars)]
    if config.script:
        rules.append(("script_impurity", M.script_ratio(t, config.script) < config.min_script_ratio))
    rules += [
        ("repeated_lines", M.repeated_line_fraction(t) > config.max_repeated_lines),
        ("symbol_spam", M.symbol_to_word_ratio(t) > config.max_symbols),
        ("word_len", (M.mean_word_length(t) < config.min_word_length) | (M.mean_word_length(t) > config.max_word_length)),
        ("boilerplate", contains_any(t, config.furniture)),
    ]
    return first_reason(*rules)


@dataclass(frozen=True)
class WebConfig:
    """Limits of the web gate (fixed values)."""

    min_chars: int = 200
    script: str = "zh"
    min_script_ratio: float = 0.55
    max_digits: float = 0.25
    max_garble: float = 0.002
    max_repeated_lines: float = 0.30
    max_dup_3grams: float = 0.50
    max_dup_4grams: float = 0.42
    max_top_2gram: float = 0.20
    min_sentence_ends: float = 0.003
    drop_spam: bool = True
    strip_furniture: bool = True


#: Without one of these characters a text is no promotion, and without one of these or the words no line is furniture; one look spares all patterns.
_HAN = r"[\x{4e00}-\x{9fff}]"
_MAYBE_FURNITURE = rf"{_HAN}|All Rights Reserved|play\s+stop"


def is_spam(text: Column) -> Column:
    """A gambling promotion, or a contact next to a solicitation."""
    return text.rlike(_HAN) & (text.rlike(GAMBLING) | (text.rlike(SOLICITATION) & text.rlike(CONTACT)))


def strip_furniture_lines(text: Column) -> Column:
    """Without lines of page furniture; blank lines stay, at most one at a time."""
    pattern = "|".join(FURNITURE_LINES)
    kept = F.filter(N.lines(text), lambda x: ~(x.rlike(_MAYBE_FURNITURE) & (N.strip(x) != "") & x.rlike(pattern)))
    return N.strip(N.limit_blank_lines(F.when(text.rlike(_MAYBE_FURNITURE), N.join_lines(kept)).otherwise(text)))


def web_gate(docs: DataFrame, config: WebConfig = WebConfig(), normalize=N.normalize_web) -> DataFrame:
    """Adds clean_text (null where dropped) and reason, the strict web gate.

    Stripped text is taken only if something is left of it.
    """
    d = docs.withColumn("_t", normalize(F.col("text")))
    if config.strip_furniture:
        stripped = strip_furniture_lines(F.col("_t"))
        d = d.withColumn("_s", stripped).withColumn("_t", F.when(F.col("_s") != "", F.col("_s")).otherwise(F.col("_t"))).drop("_s")
    t = F.col("_t")
    spam = is_spam(t) if config.drop_spam else F.lit(False)
    first = first_reason(
        ("empty", t == ""),
        ("too_short", F.length(t) < config.min_chars),
        ("spam", spam),
        ("garbled", M.garble_ratio(t) > config.max_garble),
        ("low_script", M.script_ratio(t, config.script) < config.min_script_ratio),
        ("digit_heavy", M.digit_ratio(t) > config.max_digits),
        ("no_sentences", M.sentence_end_ratio(t, config.script) < config.min_sentence_ends),
        ("repeated_lines", M.repeated_line_fraction(t) > config.max_repeated_lines),
    )
    # n-grams are taken only of texts that pass all rules before
    d = d.withColumn("_r", first).withColumn("_g", M.ngram_shares(F.when(F.col("_r") == "", M.compact(t))))
    last = first_reason(
        ("ngram_spam", F.col("_g.top_2") > config.max_top_2gram),
        ("repetitive", (F.col("_g.repeated_3") > config.max_dup_3grams) | (F.col("_g.repeated_4") > config.max_dup_4grams)),
    )
    d = d.withColumn("reason", F.when(F.col("_r") != "", F.col("_r")).otherwise(last)).withColumn("clean_text", F.when(F.col("reason") == "", t))
    return d.drop("_t", "_r", "_g")


@dataclass(frozen=True)
class RunningTextConfig:
    """The gate of a corpus in one script, with limits on foreign letters."""

    script: str = "mongolian"
    min_chars: int = 80
    min_script_ratio: float = 0.55
    max_latin: float = 0.20
    max_cyrillic: float = 0.0
    max_symbols: float = 0.35
    max_repeated_lines: float = 0.25


def running_text_reason(text: Column, config: RunningTextConfig = RunningTextConfig()) -> Column:
    t = F.coalesce(text, F.lit(""))
    seen = M.visible(t)
    return first_reason(
        ("too_short", M.text_counts(t)["n_stripped"] < config.min_chars),
        ("pua", t.rlike(r"[\x{e000}-\x{f8ff}]")),
        ("control", t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")),
        ("empty", seen == 0),
        ("script_impurity", M.script_ratio(t, config.script) < config.min_script_ratio),
        ("latin_noise", M.ratio(M.count_of(t, "A-Za-z"), seen) > config.max_latin),
        ("cyrillic_noise", M.ratio(M.count_of(t, r"\x{0400}-\x{04ff}"), seen) > config.max_cyrillic),
        ("symbol_spam", M.symbol_to_word_ratio(t) > config.max_symbols),
        ("repeated_lines", M.repeated_line_fraction(t) > config.max_repeated_lines),
    )


#: Strings and forms of lines that are no running text in the traditional script (fixed values).
LINE_SNIPPETS = ("Copyright", "All Rights Reserved", "版权所有", "蒙ICP备", "京ICP备", "ICP备", "未经授权", "ᠠᠭᠤᠯᠭ᠎ᠠ ᠨᠢ ᠰᠦᠯᠵᠢᠶ᠎ᠡ ᠡᠴᠡ ᠢᠷᠡᠯᠲᠡ", "ᠡᠷᠬᠡ ᠳᠦ ᠬᠠᠯᠳᠠᠭᠰᠠᠨ", "ᠪᠢᠳᠡ ᠲᠡᠷᠡ ᠳᠠᠷᠤᠢ ᠬᠠᠰᠤᠨ᠎ᠠ")
DECORATION = rf"^[{N.SPACE}★☆*#=_\-—–·•|<>《》［\]\[\]（）()【】{{}}:：;；,.，。、!?！？~～]+$"
BARE_HEADING = rf"^(?:ᠭᠠᠷᠴᠠᠭ|ᠲᠣᠳᠣᠷᠬᠠᠶᠢᠯᠠᠯᠲᠠ)[{N.SPACE}]*(?:\(\)|（\）)?$"


def is_running_line(line: Column, script: str = "mongolian", least: int = 4, short: int = 40) -> Column:
    """Whether a normalized line is text: not empty, no furniture, decoration or bare heading, and long or with some letters of the script."""
    lettered = M.count_of(line, M.script_class(script))
    return (line != "") & ~contains_any(line, LINE_SNIPPETS) & ~line.rlike(DECORATION) & ~line.rlike(BARE_HEADING) & ~((lettered < least) & (F.length(line) < short))


def running_lines(text: Column, script: str = "mongolian") -> Column:
    """The lines of a text, normalized, that are running text; joined again."""
    return N.join_lines(F.filter(F.transform(N.lines(text), N.normalize_running_line), lambda x: is_running_line(x, script)))


@dataclass(frozen=True)
class BucketConfig:
    language: str
    domain: str
    script: str = ""
    min_chars: int = 80
    min_script_ratio: float = 0.35
    max_replacement: float = 0.01
    max_repeated_lines: float = 0.55
    max_symbols: float = 0.12


#: The buckets of the expansion corpora (fixed values).
BUCKETS = {
    "zh_classical": BucketConfig("zh", "classical_literature", "zh", 20, 0.30),
    "zh_legal": BucketConfig("zh", "law_policy", "zh", 80, 0.35),
    "zh_philosophy_dialectics": BucketConfig("zh", "philosophy_dialectics", "zh", 80, 0.35),
    "ja_literature": BucketConfig("ja", "literature", "ja", 80, 0.25),
    "ja_legal": BucketConfig("ja", "law_policy", "ja", 120, 0.25),
    "mn_cyrillic_culture": BucketConfig("mn-Cyrl", "culture_history", "cyrillic", 40, 0.35),
    "mn_cyrillic_legal": BucketConfig("mn-Cyrl", "law_policy", "cyrillic", 120, 0.35),
    "code": BucketConfig("code", "programming"),
}


def bucket_reason(text: Column, config: BucketConfig) -> Column:
    """The gate of one bucket; symbols are counted for each character, and not in code."""
    t = F.coalesce(text, F.lit(""))
    rules = [
        ("too_short", F.length(t) < config.min_chars),
        ("decode_replacement", M.replacement_ratio(t) > config.max_replacement),
        ("error_page", contains_any(t, ERROR_PAGES)),
    ]
    if config.script:
        rules.append(("script_impurity", M.script_ratio_no_digits(t, config.script) < config.min_script_ratio))
    rules.append(("repeated_lines", M.repeated_line_fraction(t, 4) > config.max_repeated_lines))
    if config.language != "code":
        rules.append(("symbol_spam", M.symbol_to_char_ratio(t) > config.max_symbols))
    return first_reason(*rules)


def reason_counts(judged: DataFrame, *keys: str) -> DataFrame:
    """Documents by reason, and their share of all documents of the keys."""
    counts = judged.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n_docs"))
    if not keys:
        return counts
    totals = counts.groupBy(*keys).agg(F.sum("n_docs").alias("n_total"))
    return counts.join(totals, list(keys)).select(*keys, "reason", "n_docs", "n_total")


def reason_counts_by_each(judged: DataFrame, *keys: str) -> DataFrame:
    """Documents by reason for each key by itself, in one pass (grouping sets); other keys are null."""
    columns = [F.col(k) for k in (*keys, "reason")]
    return judged.groupingSets([[F.col(k), F.col("reason")] for k in keys], *columns).agg(F.count(F.lit(1)).alias("n_docs"))
