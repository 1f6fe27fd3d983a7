import random

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lakecorpus.llm import line_dedup
from lakecorpus.llm.line_dedup import dedup_lines


def brute(rows):
    """rows: (doc_id, text) in order, ids unique."""
    sets, out = [], {}
    for d, text in sorted(rows):
        n = 0
        for line in text.split("\n"):
            s = frozenset(line.split())
            n += bool(s) and any(len(s & o) * 10 >= 8 * len(s | o) for o in sets)
            if s:
                sets.append(s)
        out[d] = n
    return out


def test_equals_brute_force(docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 14, 25]))] for _ in range(60)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice([*words, f"x{rng.random()}"])
            lines.append(" ".join(line))
        rows.append((d, "\n".join([*lines, ""])))
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_removes_the_later_and_keeps_the_rest(docs_of):
    a = "The quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(2, f"{a} today\nunique words of the second one"), (1, f"{a}\n\nonly here"), (3, a.replace('quick', 'slow'))]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: f"{a}\n\nonly here", 2: "unique words of the second one", 3: ""}


def test_case_is_folded(docs_of):
    a = "The quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, a), (2, a.upper()), (3, a.title()), (4, "Élan Vital"), (5, "ÉLAN vital\nother words"), (6, "None of these")]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: (a, 0), 2: ("", 1), 3: ("", 1), 4: ("Élan Vital", 0), 5: ("other words", 1), 6: ("None of these", 0)}
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(d, "\n".join(" ".join(rng.choice([str.upper, str.title, str.lower])(w) for w in rng.sample(words, rng.choice([1, 2, 5, 9]))) for _ in range(4))) for d in range(80)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs_of(rows)).collect()}
    assert got == brute([(d, text.lower()) for d, text in rows])


def test_spaces_of_all_kinds(docs_of):
    rows = [(1, "one two  three\tfour\x0bfive\n \t\n"), (2, " one\x0ctwo three four\r\nfive"), (3, "  five four three two one\r\n\x0b"), (4, "one\xa0two three four five")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: ("five", 2, 1), 3: ("\x0b", 2, 1), 4: (rows[3][1], 1, 0)}


def test_columns_pass_whatever_their_names(docs_of, clashing):
    docs = clashing(docs_of(["a b c\nd e f", "d e f\ng h i"]))
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and clashing.unharmed(got)
    assert {r.doc_id: r.text for r in got.collect()} == {0: "a b c\nd e f", 1: "g h i"}


def test_odd_rows(odd_docs):
    got = dedup_lines(odd_docs)
    assert set(odd_docs.columns) < set(got.columns)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert [(r.text, r.n_lines) for r in rows if r.doc_id == 1] == [(None, 0)]
    assert [r.n_removed for r in rows if r.doc_id == 4] == [0, 0]
    assert [r.n_removed for r in rows if r.doc_id == 5] == [1]
    assert dedup_lines(odd_docs.limit(0)).count() == 0


def test_verification_takes_only_lines_in_pairs(docs_of, monkeypatch):
    """op10: all lines are made from the texts twice, for the ranks and for the codes; the two verifications take out only lines that stand in a pair."""
    made = []
    lines = line_dedup._lines
    monkeypatch.setattr(line_dedup, "_lines", lambda docs: made.append(1) or lines(docs))
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, f"{a}\nalone here\n{b}"), (2, f"{b} more"), (3, f"{a}\nalone here\n{b}"), (None, f"{a} last\nother words"), (None, f"{a} last\nother words"), (4, "no like of it\n\n")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_removed) for r in dedup_lines(docs_of(rows)).collect())
    assert got == [(False, 1, rows[0][1], 0), (False, 2, "", 1), (False, 3, "", 3), (False, 4, rows[5][1], 0), (True, 0, "other words", 1), (True, 0, "other words", 1)]
    assert len(made) == 2


def test_codes_are_sorted_as_plain_numbers(docs_of):
    """op10: no code is null by its type, else Spark sorts boxed values; the ranks are whole and the codes stand in order."""
    docs = docs_of([(1, "the rare the fox\nthe  fox "), (2, "the end")])
    lines = line_dedup._lines(docs).select(line_dedup._codes(F.col("_text"), line_dedup.rarity_ranks(docs)).alias("c"))
    assert lines.schema["c"].dataType == ArrayType(LongType(), containsNull=False)
    assert all(r.c == sorted(set(r.c)) for r in lines.collect()) and sorted(len(r.c) for r in lines.collect()) == [2, 2, 3]
