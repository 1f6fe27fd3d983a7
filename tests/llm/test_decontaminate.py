import random
import re

import pytest
from lakecorpus.llm.decontaminate import ContainmentConfig, drop_contaminated, leaks, least_matches


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(2000))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 8, 12, 20, 45, 90, 300])]
    rows = []
    for d in range(60):
        w = [word() for _ in range(rng.choice([10, 100, 2000]))]
        for _, text in rng.sample(items, 3):
            part = text.split()
            if rng.random() < 0.5:
                part = part[: max(1, int(len(part) * rng.uniform(0.5, 1)))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(w))
            w[at:at] = part
        rows.append((d, ", ".join(w).upper() if d % 2 else " ".join(w)))
    return rows, items


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rows, items = corpus()
    return rows, items, docs_of(rows), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(tables):
    rows, items, docs, bench = tables
    want = {}
    for d, text in rows:
        w = re.findall(r"[^\W_]+", text.lower())
        for i, t in items:
            k = min(5, len(t.split()))  # a short item is one run of all its words
            mine, s = ({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} for x in (w, t.lower().split()))
            if s and 10 * len(mine & s) >= 8 * len(s):
                want[d, i] = (len(s), len(mine & s))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in leaks(docs, bench).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in drop_contaminated(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


def test_short_items(docs_of, spark):
    docs = docs_of(["alpha Beta, gamma! delta", "alpha beta gamma", "beta alpha gamma delta epsilon zeta", "some words, then alpha beta gamma and more words", "alpha", "one two three four five six", None, ""])
    bench = spark.createDataFrame([(1, "Alpha beta GAMMA"), (2, "epsilon zeta"), (3, "one two three four five"), (4, "!"), (5, "two three four five")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.containment) for r in leaks(docs, bench).collect())
    assert got == [(0, 1, 1, 1.0), (1, 1, 1, 1.0), (2, 2, 1, 1.0), (3, 1, 1, 1.0), (5, 3, 1, 1.0), (5, 5, 1, 1.0)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, ContainmentConfig(least_words=3)).collect()) == [2, 4, 6, 7]


def test_columns_pass_whatever_their_names(docs_of, spark, clashing):
    docs = clashing(docs_of(["a b c d e f g h", "other words entirely in this one text"]))
    got = drop_contaminated(docs, spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string"))
    assert got.columns == docs.columns and clashing.unharmed(got) and [r.doc_id for r in got.collect()] == [1]


def test_sketches_miss_little():
    c = ContainmentConfig()
    for width in c.widths:
        k = least_matches(width, c.containment, c.miss)
        rng = random.Random(width)
        missed = sum(sum(rng.random() < c.containment for _ in range(width)) < k for _ in range(20_000))
        assert k >= 1 and missed <= 2


def test_odd_rows(odd_docs, spark):
    bench = spark.createDataFrame([(1, "same text here same text here"), (None, "word1 word2 word3 word4 word5 word6"), (2, None), (3, ""), (4, "too short"), (1, "same text here same text here")], "item_id long, text string")
    rows = [(r.doc_id, r.item_id) for r in leaks(odd_docs, bench).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(4, 1), (4, 1), (5, 1), (3, None)]))
    kept = drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "7", "None"]
    assert leaks(odd_docs.limit(0), bench).count() == 0 and leaks(odd_docs, bench.limit(0)).count() == 0
    assert drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
