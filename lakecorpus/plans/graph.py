"""Jobs as a graph of stages that rerun only where something changed.

A stage makes one folder from files and from the folders of other stages. Its signature covers its settings, the listings of its files, and the signatures of the stages before
it; it is kept beside the folder once that is finished. So a changed leaf changes the signatures of its descendants and of no other stage, and what was broken off or deleted is made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from lakecorpus.sources import store

from .jobs import is_fresh, remember

MADE, REUSED, MISSING, EMPTY, FAILED, BLOCKED, WOULD = "made", "reused", "missing", "empty", "failed", "blocked", "would make"


@dataclass(frozen=True)
class Stage:
    """``make(spark, inputs, out)`` writes ``out`` and may return how many rows it wrote. ``inputs`` has the paths of files and of the stages before, by name."""

    name: str
    make: Callable[[SparkSession, dict[str, str], str], int | None]
    files: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    settings: tuple = ()
    #: Whether files that aren't there end the run of this stage (else it goes on without them).
    needs_files: bool = True


def signatures(spark: SparkSession, stages: list[Stage]) -> dict[str, str]:
    """The signature of each stage, in an order in which they can run; a circle or an unknown stage raises."""
    by_name = {s.name: s for s in stages}
    if len(by_name) < len(stages):
        raise ValueError("two stages have one name")
    if unknown := {a for s in stages for a in s.after} - set(by_name):
        raise ValueError(f"there are no stages {sorted(unknown)}")
    out: dict[str, str] = {}
    for name in TopologicalSorter({s.name: s.after for s in stages}).static_order():
        s = by_name[name]
        facts = (s.name, s.settings, [(f, store.listing(spark, f)) for f in s.files], [(a, out[a]) for a in s.after])
        out[name] = hashlib.sha256(repr(facts).encode()).hexdigest()
    return out


def run(spark: SparkSession, stages: list[Stage], folder: str, force: bool = False, dry_run: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """Runs stages whose result isn't fresh, each after those before it, and reports (stage, state, path, rows, error).

    States: made, reused, would make (``dry_run``: nothing is written), missing (none of its files is there), empty (it wrote no rows), failed, blocked (a stage before it has no result). One that fails ends no other
    branch. ``force`` makes all again; ``only`` names stages to bring up to date, with those before them.
    """
    by_name = {s.name: s for s in stages}
    now = signatures(spark, stages)
    wanted = set(only) or set(by_name)
    for name in reversed(list(now)):
        if name in wanted:
            wanted |= set(by_name[name].after)
    state: dict[str, str] = {}
    report = []
    for name, signature in now.items():
        if name not in wanted:
            continue
        s, out, rows, error = by_name[name], f"{folder}/{name}", None, None
        bad = [a for a in s.after if state[a] not in (MADE, REUSED, WOULD)]
        if bad:
            state[name], error = BLOCKED, ", ".join(bad)
        elif s.files and s.needs_files and not any(store.listing(spark, f) for f in s.files):
            state[name] = MISSING
        elif not force and is_fresh(spark, out, signature):
            state[name] = REUSED
        elif dry_run:
            state[name] = WOULD
        else:
            inputs = {**{f: f for f in s.files}, **{a: f"{folder}/{a}" for a in s.after}}
            try:
                store.delete(spark, f"{out}.signature")  # until it is finished, no result is fresh
                rows = s.make(spark, inputs, out)
                if rows == 0:
                    state[name] = EMPTY
                else:
                    remember(spark, out, signature)
                    state[name] = MADE
            except Exception as e:  # noqa: BLE001 - other branches go on; the report has it
                state[name], error = FAILED, f"{type(e).__name__}: {str(e)[:500]}"
        report.append((name, state[name], out, rows, error))
    return spark.createDataFrame(report, "stage string, state string, path string, rows long, error string")
