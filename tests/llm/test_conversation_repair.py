import hashlib
import random
import zlib
from itertools import product

from hypothesis import given
from hypothesis import strategies as st
from lakecorpus.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        out += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, audit, repaired) over all ways, forward over the states of the roles so far: '' , s, u, a."""
    ok = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for q, (c, a, t) in list(best.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (q, r) in ok:
                        new = (c + 2, a + "I", t + (f"{name}:",))
                        best[r] = min(best.get(r, new), new)
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), f in zip(rows, fault, strict=True):
        to = {}
        for q, (c, a, t) in best.items():
            ways = [(q, (c + 3, a + "D", t))]
            if f not in ("blank", "duplicate"):
                x = f == "truncated"
                ways += [(r, (c + 2 + x, a + "R", t + (f"{n}:{text}",))) for r, n in (("u", "user"), ("a", "assistant")) if (q, r) in ok]
                if (q, role[:1]) in ok:
                    ways.append((role[:1], (c + x, a + "K", t + (f"{role}:{text}",))))
            for r, w in ways:
                to[r] = min(to.get(r, w), w)
        best = inserted(to)
    return min(w for q, w in best.items() if q in ("", "a"))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        fault = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(mine, fault)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = cr.digests(cr.repair(cr.mark_faults(cr.damage(df)))).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r) for r in got}


kinds = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "blank", "duplicate", "truncated"]))


@given(st.lists(kinds, max_size=9))
def test_scan_and_trace_equal_the_least_way(kinds):
    rows = [(k, role, f"t{k}") for k, (role, _) in enumerate(kinds)]
    fault = [f for _, f in kinds]
    auto, behind, state = cr.CostAutomaton(), [], None
    state = auto.end
    for role, f in reversed(kinds):
        behind.append(state)
        i = cr.INITIALS.find(role[:1]) if role else -1
        state = auto.step(state, (i if i >= 0 else 3) * 3 + (cr.MUST_GO if f in ("blank", "duplicate") else cr.CUT_OFF if f else cr.SOUND))
    letters, q = "", 0
    for (role, f), after in zip(kinds, reversed(behind), strict=True):
        i = cr.INITIALS.find(role[:1]) if role else -1
        edits, q = auto.trace(after, (i if i >= 0 else 3) * 3 + (cr.MUST_GO if f in ("blank", "duplicate") else cr.CUT_OFF if f else cr.SOUND), q)
        letters += "".join(e for e, _ in edits)
    letters += "I" * len(auto.tail(q))
    assert letters == cheapest(rows, fault)[1]


def test_few_states():
    auto = cr.CostAutomaton()
    k = 0
    while k < len(auto.vectors):
        for s in range(auto.SYMBOLS):
            auto.step(k, s)
        k += 1
        assert k < 200
    assert all(0 <= c < 255 for v in auto.vectors for c in v)
    assert all(auto.of_code(auto.code(k)) == k for k in range(len(auto.vectors)))
    for k, s, q in product(range(len(auto.vectors)), range(auto.SYMBOLS), range(4)):
        auto.trace(k, s, q)


def test_equals_brute_force(spark):
    pick = random.Random(3)
    texts = ["Yes.", "no", "", " \t\n", "What? ", "Well!\n", "a.b", "字。", None, "x" * 2000 + "."]
    roles = ["system", "user", "assistant", "tool", None, ""]
    rows = []
    for conv in [*range(150), None]:
        turn = 0
        for _ in range(pick.choice([1, 2, 3, 5, 9, 14])):
            turn += pick.choice([0, 1, 1, 1, 1, 3])
            rows.append((conv, None if pick.random() < 0.05 else turn, pick.choice(roles), pick.choice(texts)))
    rows += rows[:40]
    rows += [(1000, None, None, None), (1000, None, "user", "Hi."), (1001, 5, "system", "s."), (2000, 0, "user", "long. " * 300_000)]
    rows += [(3000, k, "user" if k % 2 else "assistant", "so it goes." if k % 3 else f"turn {k}!") for k in range(5000)]
    rows += [(conv, 0, "user", "Alone?") for conv in range(5000, 5060)]  # some of them lose their only row
    want = brute(rows)
    assert result(spark, rows) == want
    assert any(w[7] == "" for w in want.values()) and {c for w in want.values() for c in w[7]} == set("KRDI")


def test_edits_are_the_rows_of_a_conversation(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hello?"), (7, 2, "user", "Are you there?"), (7, 3, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, False) for r in rows], SCHEMA + ", gone boolean")
    got = cr.repair(cr.mark_faults(df)).orderBy("seq").collect()
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "system", "Be kind."), ("K", "user", "Hello?"), ("I", "assistant", ""), ("K", "user", "Are you there?"), ("K", "assistant", "Yes.")]


def test_empty_clashing_and_plan(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "assistant", "b.")], SCHEMA)
    clash = df.withColumns({n: F.lit(n) for n in ("gone", "kind", "times", "fault", "symbol", "behind", "seq", "_nth")})
    out = cr.digests(cr.repair(cr.mark_faults(cr.damage(clash))))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before it runs: one shuffle
    assert [tuple(r) for r in out.collect()] == [brute([(1, 1, "user", "a."), (1, 2, "assistant", "b.")])[1]]
    assert cr.digests(cr.repair(cr.mark_faults(cr.damage(df.limit(0))))).count() == 0
