import random
import re
from itertools import combinations

import numpy as np
import pytest
from lakecorpus.llm.components import components
from lakecorpus.llm.ngram_join import JoinConfig, keep_one_of_each, ngram_sets, signatures, similar_classes


def brute(rows):
    """(class_id, n_links) of each (doc_id, text); ids unique."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (find(d), links[d]) for d in sets}


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    rows, d = [], 0
    for size in (1, 1, 1, 2, 3, 5, 60):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append((d, " ".join(w)))
            d += 1
    return [*rows, (d, "three short words"), (d + 1, "Three, short words!"), (d + 2, ""), (d + 3, None), (d + 4, "...")]


@pytest.mark.parametrize("config", [JoinConfig(), JoinConfig(block=7, batch=10)])
def test_equals_brute_force(docs_of, config):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_classes(docs_of(rows), config).collect()}
    assert got == brute(rows)


def test_query_on_a_whole_table(spark):
    from lakecorpus.llm.queries import queries

    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries()["op7_ngram_join"](spark, at).collect()} == brute(rows)


def test_signatures_estimate_the_similarity():
    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b = a[:320] + [f"v{i}" for i in range(80)]
    x, y = ngram_sets([" ".join(a), " ".join(b)], 5)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    s = signatures([x, y], 500)
    assert abs((s[0] == s[1]).mean() - true) < 0.08
    assert JoinConfig().depth == 3


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows_and_one_of_each(odd_docs):
    rows = similar_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (4, 5)} == {(4, 2)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2, 6)} == {(1, 1, 0), (2, 2, 0), (6, 6, 0)}
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [*[(False, d) for d in (1, 2, 3, 4, 6, 7)], (True, None)]
    assert keep_one_of_each(odd_docs.limit(0)).count() == 0


def test_columns_pass_whatever_their_names(docs_of, clashing):
    docs = clashing(docs_of(["a b c d e f g h", "a b c d e f g h", "other words entirely in this text"]))
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns and clashing.unharmed(got) and sorted(r.doc_id for r in got.collect()) == [0, 2]
