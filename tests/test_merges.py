import random
from collections import Counter

import duckdb
import pytest
from lakecorpus.operators import merges as M
from pyspark.sql import functions as F


def plain(counts, k, least=2):
    """One pair after the other; ``counts`` has (word, n, barred)."""
    rows = [[[(c, i + 1) for i, c in enumerate(w)], n, set(barred)] for w, n, barred in counts]
    out = []
    while len(out) < k:
        f = Counter()
        for s, n, barred in rows:
            for (a, end), (b, _) in zip(s, s[1:]):
                if end not in barred:
                    f[a, b] += n
        if not f or max(f.values()) < least:
            break
        best = min(f, key=lambda p: (-f[p], p))
        out.append((*best, f[best]))
        for r in rows:
            s, i, new = r[0], 0, []
            while i < len(s):
                if i + 1 < len(s) and (s[i][0], s[i + 1][0]) == best and s[i][1] not in r[2]:
                    new.append((s[i][0] + s[i + 1][0], s[i + 1][1]))
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            r[0] = new
    return out, {"".join(x for x, _ in s): [x for x, _ in s] for s, _, _ in rows}


def learned(spark, counts, config):
    df = spark.createDataFrame(counts, "word string, n long, barred array<int>")
    out, words = M.learn_merges(df, config)
    got = [(r.left, r.right, r.n) for r in out.orderBy("rank").collect()]
    assert [r.merged for r in out.orderBy("rank").collect()] == [a + b for a, b, _ in got]
    return got, {r.word: r.s for r in words.select("word", M.symbol_list(F.col("symbols")).alias("s")).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_equal_the_plain_loop(spark, seed):
    pick = random.Random(seed)
    words = {"".join(pick.choice("aabcde"[: 2 + 2 * seed]) for _ in range(pick.randint(1, 9))) for _ in range(60)} | {"aaaaaaaa", "abababab", "字母字母", "😀😀x"}
    counts = [(w, pick.randint(1, 40), sorted(pick.sample(range(1, len(w) + 1), min(len(w), pick.choice([0, 0, 1]))))) for w in sorted(words)]
    for most in (1, 64):
        got, left = learned(spark, counts, M.MergeConfig(merges=12, most_at_once=most))
        want, symbols = plain(counts, 12)
        assert got == want and left == symbols


def test_rounds_take_more_than_one_pair(spark):
    counts = [("ab", 50, []), ("cd", 40, []), ("ef", 30, []), ("ac", 20, [])]
    top = [type("R", (), {"left": w[0], "right": w[1], "n": n}) for w, n, _ in counts]
    assert [r.left for r in M._first_untouched(top, set())] == ["a", "c", "e"]
    assert [r.left for r in M._first_untouched(top[:2] + top[3:], set())] == ["a", "c"]
    assert [r.left for r in M._first_untouched(top, {"cd"})] == ["a"]
    tie = [*top[:2], type("R", (), {"left": "b", "right": "x", "n": 40})]
    assert [r.left for r in M._first_untouched(tie, set())] == ["a"]  # as common as the first that touches: its turn comes later


def test_odd_words(spark):
    counts = [(None, 5, None), ("", 5, []), ("x", 9, []), ("aa", 1, []), ("a" * 3000, 1, []), ("a﷐b", 7, []), ("zz", 3, None)]
    got, left = learned(spark, counts, M.MergeConfig(merges=4))
    assert got == plain([(w.replace("﷐", "�"), n, b or []) for w, n, b in counts if w is not None], 4)[0]
    assert "".join(left["a﷐b"]) == "a�b" and left["x"] == ["x"] and left[""] == []
    assert learned(spark, counts[:0], M.MergeConfig())[0] == []
    assert learned(spark, [("ab", 1, [])], M.MergeConfig())[0] == []  # under the least count


def test_query_equals_its_sql(spark):
    from lakecorpus.queries import QUERIES

    f, sql = QUERIES["train_merges"]
    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    assert sorted(map(tuple, f(spark, at).select("rank", "left", "right", "merged", "n").collect())) == sorted(db.sql(f'SELECT rank, "left", "right", merged, n FROM ({sql})').fetchall())
