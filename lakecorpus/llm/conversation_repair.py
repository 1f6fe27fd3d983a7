"""Repair of the turn structure of conversations at least cost, by lazy weighted determinisation.

What a conversation may look like is an automaton of four states over role initials. A row can be kept, given another role or deleted, and rows can be inserted, each at a cost; so
what is still to be paid after a row is a vector with a cost for each state. Less their least entry these vectors are few: they become the states of a
deterministic automaton, found as they are met and cached in a transition table. One look-up a row gives the costs of a conversation, whatever its length.

The scan reads the rows from the last to the first. The trace goes back over it, from the first row to the last, along arcs that are tight (their
cost is the difference of the vectors at their ends), and takes the least letter at each place, so the audit is the least one of all cheapest.

Both are streams over sorted partitions that hold one row at a time: a conversation may be of any length. A partition is shuffled once, by conversation,
then sorted in itself three times, on disk if need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES

#: Costs of edits; a kept or changed row that breaks off costs one more.
CHANGE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
KEEP_ROW, CHANGE_ROLE, DELETE_ROW, INSERT_ROW = "KRDI"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row. A conversation may end in ENDS.
ARCS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What can be put next where a row is inserted or given another role, and the state behind it.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
INITIALS = "sua"  # any other has the number after them
MUST_GO, SOUND, CUT_OFF = range(3)

Vector = tuple[int, ...]


def _with_inserts(cost: list[float]) -> list[float]:
    """Costs once rows may be inserted first; no path inserts more than one for each state."""
    for _ in ARCS:
        cost = [min(c, INSERT + cost[NEXT[q][1]]) for q, c in enumerate(cost)]
    return cost


def _before(after: Vector, symbol: int) -> list[int]:
    """The costs in front of a row from those behind it."""
    initial, kind = divmod(symbol, 3)
    cost: list[float] = []
    for q in range(len(ARCS)):
        ways = [DELETE + after[q]]
        if kind != MUST_GO:
            extra = BROKEN * (kind == CUT_OFF)
            ways.append(CHANGE + extra + after[NEXT[q][1]])
            if initial < len(INITIALS) and INITIALS[initial] in ARCS[q]:
                ways.append(extra + after[ARCS[q][INITIALS[initial]]])
        cost.append(min(ways))
    return [int(c) for c in _with_inserts(cost)]


class CostAutomaton:
    """States are normalised vectors of what is still to be paid, numbered as they are met."""

    SYMBOLS = 3 * (len(INITIALS) + 1)

    def __init__(self):
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        self.table: list[int] = []  # -1: not met yet
        self.traced: dict[tuple[int, int, int], tuple[tuple[tuple[str, str | None], ...], int]] = {}
        ends = [0 if q in ENDS else float("inf") for q in range(len(ARCS))]
        self.end = self.state(tuple(int(c) for c in _with_inserts(ends)))

    def state(self, vector: Vector) -> int:
        at = self.number.get(vector)
        if at is None:
            at = self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table += [-1] * self.SYMBOLS
        return at

    def step(self, state: int, symbol: int) -> int:
        """The state in front of a row from the one behind it."""
        k = state * self.SYMBOLS + symbol
        at = self.table[k]
        if at < 0:
            cost = _before(self.vectors[state], symbol)
            at = self.state(tuple(c - min(cost) for c in cost))
            self.table[k] = at
        return at

    def code(self, state: int) -> int:
        """A state as a number that other tasks understand."""
        return sum(c << (8 * k) for k, c in enumerate(self.vectors[state]))

    def of_code(self, code: int) -> int:
        return self.state(tuple(code >> (8 * k) & 255 for k in range(len(ARCS))))

    def trace(self, state: int, symbol: int, q: int) -> tuple[tuple[tuple[str, str | None], ...], int]:
        """The edits (letter, new role) up to and with a row's own, and the state of the roles behind them. ``state`` is the one behind the row."""
        key = (state, symbol, q)
        if key not in self.traced:
            after, (initial, kind) = self.vectors[state], divmod(symbol, 3)
            cost, extra, edits = _before(after, symbol), BROKEN * (kind == CUT_OFF), []
            while True:
                role, to = NEXT[q]
                arc = ARCS[q].get(INITIALS[initial]) if initial < len(INITIALS) else None
                if cost[q] == DELETE + after[q]:
                    edits.append((DELETE_ROW, None))
                    break
                if cost[q] == INSERT + cost[to]:
                    edits.append((INSERT_ROW, ROLES[role]))
                    q = to
                elif arc is not None and cost[q] == extra + after[arc]:
                    edits.append((KEEP_ROW, None))
                    q = arc
                    break
                else:
                    edits.append((CHANGE_ROLE, ROLES[role]))
                    q = to
                    break
            self.traced[key] = tuple(edits), q
        return self.traced[key]

    def tail(self, q: int) -> list[str]:
        """The roles to insert behind the last row."""
        roles = []
        while q not in ENDS:
            role, q = NEXT[q]
            roles.append(ROLES[role])
        return roles


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults planted by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's.

    Null roles, texts and parts of the key are one space each. A dropped row stays as a row that is ``gone``, without role and text, so its conversation isn't lost. Other columns are ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    kind, gone = F.col("kind"), F.col("kind") == 0
    text = F.when(gone, F.lit(None)).when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, F.lit(None)).when(kind == 4, "user").otherwise(F.col("role"))
    changed = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return changed.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def mark_faults(rows: DataFrame) -> DataFrame:
    """Adds fault to rows (conv_id, turn, role, text, gone): ``blank`` without any character but spaces, ``duplicate`` if role and text were there before, ``truncated`` if the last such character isn't one of ``.!?``, else ''.

    The first that holds counts; rows that are gone have none. The rows come dealt out by conversation.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    # the window finds its rows together, as all of a conversation are: it sorts, but shuffles nothing
    seen = rows.repartition(n, "conv_id").withColumn("_nth", F.row_number().over(same))
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(F.col("gone"), "").when(end == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return seen.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the state behind it; conversations come in order, their rows from the last to the first."""
    automaton = CostAutomaton()
    now, state = object(), automaton.end
    for batch in batches:
        behind = []
        for conv, symbol, gone in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "symbol", "gone")], strict=True):
            if conv != now:
                now, state = conv, automaton.end
            behind.append(automaton.code(state))
            if not gone:
                state = automaton.step(state, symbol)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(behind, type=pa.int64())], names=[*batch.schema.names, "behind"])


_EDITS = (("conv_id", "long"), ("seq", "long"), ("edit", "string"), ("cost", "int"), ("turn", "long"), ("role_before", "string"), ("role", "string"), ("text", "string"), ("fault", "string"))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation; conversations come in order, and so do their rows."""
    automaton = CostAutomaton()
    now, q, seq, any_row = None, 0, count(), True
    out: list[tuple] = []

    def close():
        for role in automaton.tail(q):
            out.append((now, next(seq), INSERT_ROW, INSERT, None, None, role, "", ""))
        if not any_row:
            out.append((now, next(seq), None, 0, None, None, None, None, ""))

    def batch_of():
        columns = list(zip(*out, strict=True)) or [()] * len(_EDITS)
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        made = pa.RecordBatch.from_arrays([pa.array(c, type=types[t]) for c, (_, t) in zip(columns, _EDITS, strict=True)], names=[n for n, _ in _EDITS])
        out.clear()
        return made

    names = ("conv_id", "turn", "role", "text", "gone", "fault", "symbol", "behind")
    first = True
    for batch in batches:
        for conv, turn, role, text, gone, fault, symbol, behind in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if first or conv != now:
                if not first:
                    close()
                first, now, q, seq, any_row = False, conv, 0, count(), False
            if gone:
                continue
            any_row = True
            edits, q = automaton.trace(automaton.of_code(behind), symbol, q)
            for edit, new in edits:
                if edit == INSERT_ROW:
                    out.append((conv, next(seq), edit, INSERT, None, None, new, "", ""))
                else:
                    broken = BROKEN * (fault == "truncated")
                    cost = {DELETE_ROW: DELETE, KEEP_ROW: broken, CHANGE_ROLE: CHANGE + broken}[edit]
                    out.append((conv, next(seq), edit, cost, turn, role, None if edit == DELETE_ROW else new or role, text, fault))
        yield batch_of()
    if not first:
        close()
    yield batch_of()


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, cost, turn, role_before, role, text, fault): the cheapest edits of each conversation that make its role initials ``(s?(ua)+)?``, in the order of seq.

    ``rows`` (conv_id, turn, role, text, gone, fault) are as ``mark_faults`` gives them. Edits are K (keep), R (give the role user or assistant), D (delete; must be for
    blank and duplicate rows) and I (insert one without text); of equal costs the edits whose letters are least in ASCII. A deleted row has no role, an inserted one no role_before and no turn.
    A conversation's rows stand in the order of turn (nulls first), role and text; equal rows are interchangeable. A null conv_id is a conversation like others. A conversation of which
    all rows are gone has one row with a null edit. An empty table gives an empty result. The result lies dealt out by conversation and in order.
    """
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("role", 1, 1)), F.lit(0))
    number = F.when(initial == 0, len(INITIALS)).otherwise(initial - 1)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_OFF).otherwise(SOUND)
    coded = rows.select("conv_id", "turn", "role", "text", "gone", "fault", (number * 3 + kind).cast("int").alias("symbol"))
    late = F.col("fault") == "duplicate"
    back = [F.desc_nulls_last("turn"), F.desc_nulls_last("role"), F.desc_nulls_last("text"), late.desc()]
    on = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), late.asc()]
    scanned = coded.sortWithinPartitions("conv_id", *back).mapInArrow(_scan, coded.schema.add("behind", "long"))
    return scanned.sortWithinPartitions("conv_id", *on).mapInArrow(_trace, ", ".join(f"{n} {t}" for n, t in _EDITS))


_DIGESTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of what ``repair`` returns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``edits`` lie as ``repair`` leaves them: each conversation in one task, in order. gaps: turns missing between the least and the greatest; illegal: neighbours before
    the repair whose initials aren't su, ua or au; audit: the letters of the edits; repaired_sha256: of ``role:text`` of all rows that stay, joined by newlines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, first = [], None, True
        fields = [("conv_id", pa.int64()), *[(d, pa.int64()) for d in _DIGESTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
        n: dict[str, int] = {}

        def close():
            least, most, turns = span
            n["gaps"] = most - least + 1 - turns if turns else 0
            out.append({"conv_id": now, **n, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            for conv, edit, cost, turn, before, role, text, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "turn", "role_before", "role", "text", "fault")], strict=True):
                if first or conv != now:
                    if not first:
                        close()
                    first, now, n = False, conv, dict.fromkeys(_DIGESTS, 0)
                    letters, digest, joint, last, span = [], hashlib.sha256(), "", None, (0, 0, 0)
                if edit is None:
                    continue
                letters.append(edit)
                n["cost"] += cost
                if fault:
                    n[fault] += 1
                if edit != INSERT_ROW:
                    if last is not None:
                        n["illegal"] += last + before[:1] not in ("su", "ua", "au")
                    last = before[:1]
                    if turn is not None:
                        least, most, turns = span
                        span = (turn, turn, 1) if not turns else (least, turn, turns + (turn != most))
                if role is not None:
                    digest.update(f"{joint}{role}:{text}".encode())
                    joint = "\n"
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
            out = []
        if not first:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return edits.mapInArrow(run, "conv_id long, " + ", ".join(f"{d} long" for d in _DIGESTS) + ", audit string, repaired_sha256 string")
