import random
import re

from lakecorpus.llm.quality_rules import QualityConfig, keep_quality, quality_rules
from pyspark.sql import functions as F


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs_of):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "é\xa0x y\x0bz\x0cq\r\n\nq", "a " * 30, "1 2 3 4 5 6 7 8 " * 3 + "x"]
    for _ in range(60):
        w = [rng.choice(["a", "b", "#", "c|", "dé", "\n", "e\n", "f"]) for _ in range(rng.choice([5, 20, 60, 200]))]
        texts.append(rng.choice([" ", "\t", "  "]).join(w))
    got = quality_rules(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {k: brute(t) for k, t in enumerate(texts)}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_fences_follow_the_group(docs_of):
    rng = random.Random(1)
    prose = lambda: " ".join("abcdefghijk"[: rng.randint(3, 8)] + str(rng.randrange(1000)) for _ in range(80))
    clean = [(i, prose(), "en", "web") for i in range(200)]
    code = [(300 + i, " ".join(f"{w} |" for w in prose().split()), "en", "code") for i in range(200)]
    junk = [(600, " ".join(w + "###" for w in prose().split()), "en", "web"), (601, " ".join(x for w in prose().split()[:10] for x in [w] * 7), "en", "web")]
    kept = {r.doc_id: r.kept for r in quality_rules(docs_of(clean + junk)).collect()}
    assert all(kept[i] for i in range(200)) and not kept[600] and not kept[601]
    # a source may differ from its language, but not set any standard of its own
    both = {r.doc_id: r.kept for r in quality_rules(docs_of(clean + code[:40])).collect()}
    assert all(both[i] for i in range(200)) and not any(both[300 + i] for i in range(40))
    assert sum(r.kept for r in quality_rules(docs_of(clean + code), QualityConfig(over_language=10.0)).collect()) == 400


def prose(rng, n=100):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_quantiles_alone_set_the_fences(docs_of):
    """Outliers that any fixed cutoff worth its name lets pass go, and each group has fences of its own."""
    rng = random.Random(3)
    plain = [(i, prose(rng), "en", "web") for i in range(200)]
    marked = [(300 + i, " ".join(w + "|" * (k % 12 == 0) for k, w in enumerate(prose(rng).split())), "fr", "notes") for i in range(200)]
    some = lambda text: " ".join(w + "|" * (k % 12 == 0) for k, w in enumerate(text.split()))
    words = prose(rng, 300).split()
    lines = [" ".join(words[k : k + 5]) for k in range(0, 200, 5)]
    odd = {
        600: some(prose(rng)),  # 9 symbols in 100 words, where nobody else has any; usual for (fr, notes)
        601: " ".join(words + words[:40]),  # 80 of 340 words are in repeated windows: under the base rule's 30 %
        602: "\n".join(lines + lines[:6]),  # 6 of 46 lines repeat
        603: " ".join(w for k, w in enumerate(words[:100]) for _ in range(2 if k % 7 == 0 else 1)),  # 15 words said twice
        604: " ".join(w + "xyz" for w in words),
        605: " ".join(w[:3] for w in words),
    }
    rows = plain + marked + [(k, t, "en", "web") for k, t in odd.items()]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows)).collect()}
    assert not any(got[k].base_failed for k in odd)
    assert all(got[i].kept for i in range(200)) and all(got[300 + i].kept for i in range(200))
    assert [k for k in odd if got[k].kept] == []
    # a single event passes where there is none as a rule
    once = [(700, prose(rng) + " #", "en", "web"), (701, "\n".join(lines[:3] + lines[:1]) + prose(rng, 20), "en", "web")]
    got = {r.doc_id: r.kept for r in quality_rules(docs_of(plain + once)).collect()}
    assert got[700] and got[701]


def test_fences_differ_by_group(spark):
    """On the tables no two groups of a few documents have the same fences of what all texts have."""
    from lakecorpus.llm.common import cut, group_key, table
    from lakecorpus.llm.quality_rules import base_metrics, fences

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text", group_key("lang").alias("_lang"), group_key("source").alias("_source"))
    got = fences(cut(base_metrics(docs).drop("text"), "test"), QualityConfig(least_docs=10)).collect()
    for c in ("word_length_high", "word_length_low", "stutter_ratio_high"):
        assert len({r[c] for r in got}) > len(got) / 3


def test_columns_pass_whatever_their_names(docs_of, clashing):
    rng = random.Random(2)
    docs = clashing(docs_of([prose(rng) for _ in range(40)] + ["short"]))
    got = keep_quality(docs)
    assert got.columns == docs.columns and clashing.unharmed(got) and got.count() == 40


def test_odd_rows(odd_docs):
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 6, 7))
    kept = keep_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert quality_rules(odd_docs.limit(0)).count() == 0 and keep_quality(odd_docs.limit(0)).count() == 0
    assert quality_rules(odd_docs.where(F.col("text") == "")).count() == 1


def test_fences_of_rare_events(spark, docs_of):
    """Where most documents have none, the fence follows from those that have some; it isn't 0, differs by group, and grows with length."""
    from lakecorpus.llm.common import cut, group_key
    from lakecorpus.llm.quality_rules import base_metrics, fences

    rng = random.Random(4)

    def page(lines, again):
        text = [prose(rng, 9) for _ in range(lines)]
        return "\n".join(text + text[:again])

    rows = [(i, page(12, 2 if i % 10 == 0 else 0), "en", "web") for i in range(300)] + [(1000 + i, page(12, 1 if i % 25 == 0 else 0), "en", "news") for i in range(300)]
    def refrain(lines, times):
        text = [prose(rng, 9) for _ in range(lines)]
        return "\n".join(x for k, line in enumerate(text) for x in ([line, "once more"] if k < times else [line]))

    odd = {5000: page(400, 3), 5001: refrain(12, 8), 5002: refrain(400, 81)}
    docs = docs_of(rows + [(k, t, "en", "web") for k, t in odd.items()])
    measured = cut(base_metrics(docs.select("text", group_key("lang").alias("_lang"), group_key("source").alias("_source"))).drop("text"), "test")
    got = {r["_source"]: r.dup_line_ratio_high for r in fences(measured).collect()}
    assert 0 < got["news"] < got["web"] < 0.05
    # what the definition says: shares drawn towards the wider group's, times the lower quartile of those that have any; at most 1.5 times the language's
    share_all = (33 + 12) / 603
    share_lang = (45 + 30 * share_all) / 633
    share = (33 + 30 * share_lang) / (303 + 30)
    rates = sorted([2 / 14] * 30 + [3 / 403, 7 / 20, 80 / 481])
    both = sorted([*rates, *[1 / 13] * 12])
    assert abs(got["web"] - min(share * rates[8], 1.5 * share_lang * both[11])) < 1e-12
    assert abs(got["news"] - (12 + 30 * share_lang) / 330 * both[11]) < 1e-12  # too few of its own
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert kept[5000] and not kept[5001] and not kept[5002]


def test_no_fixed_count_decides(spark):
    """On the tables most fences are above 0 and differ by group; a long text may show more than a short one."""
    from lakecorpus.llm.common import cut, group_key, table
    from lakecorpus.llm.quality_rules import RULES, base_metrics, fences

    docs = table(spark, "/root/testdata/sf0.1", "documents").select("text", group_key("lang").alias("_lang"), group_key("source").alias("_source"))
    got = fences(cut(base_metrics(docs).drop("text"), "test")).collect()
    for r in RULES:
        values = [g[f"{r}_high"] for g in got]
        assert all(v > 0 for v in values) and len(set(values)) > len(values) / 2, r
