"""Cleaning of a web corpus unit by unit, so that a run that is broken off goes on where it stopped, with the same result.

A commit takes the next units in order: it writes their texts (``data``), then the keys and signatures of those (``keys``), then, as one small file, its
entry in the log (``log``). Only what the log names counts. A commit that was broken off before has no entry, so it is done again under the same
number, over whatever it left. The state of deduplication is what the logged commits kept; where its keys are lost they are made anew from the texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.functions import hashing as H
from lakecorpus.functions import textnorm as N
from lakecorpus.operators import dedup, quality
from lakecorpus.sources import readers, store

STATE = "exact_key string, sig long"


@dataclass(frozen=True)
class UnitJob:
    """What a run does with its units. A run that goes on must be given the same."""

    gate: quality.WebConfig = quality.WebConfig()
    normalize: Callable = N.normalize_web
    keys: tuple[str, ...] = ("text",)
    near: bool = True
    threshold: int = 3
    #: Characters from which texts are compared by signature, too.
    min_chars: int = 120
    #: Units of a commit.
    at_once: int = 1


def read_unit(spark: SparkSession, path: str, keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """(path, pos, text) of a unit: a file, or a member of an archive as ``file.zip!member``."""
    file, _, member = path.partition("!")
    kind = readers.infer_format(file)
    options = {"keys": keys} if kind in ("jsonl", "parquet") else {"key": keys[0], "member": member or None} if kind == "zip" else {}
    rows = readers.READERS[kind](spark, file, **options)
    pos = F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id()
    return rows.select(F.lit(path).alias("path"), pos.cast("long").alias("pos"), "text")


def log(spark: SparkSession, out: str) -> list[dict]:
    """Entries of the log in order: commit, units, counts by reason."""
    return [json.loads(store.read(spark, f"{out}/log/{n}", 1 << 30)) for n in store.names(spark, f"{out}/log") if n.startswith("commit-")]


def _signed(texts: DataFrame, job: UnitJob) -> DataFrame:
    sig = F.when(F.length("text") >= job.min_chars, H.simhash(F.col("text"))) if job.near else F.lit(None).cast("long")
    return texts.select(H.exact_key(F.col("text")).alias("exact_key"), sig.alias("sig"))


def _folder(number: int) -> str:
    return f"commit-{number:06d}"


def state(spark: SparkSession, out: str, entries: list[dict], job: UnitJob = UnitJob()) -> DataFrame:
    """(exact_key, sig) of all that the logged commits kept."""
    whole, lost = [], []
    for e in entries:
        at = f"{out}/keys/{_folder(e['commit'])}"
        (whole if store.exists(spark, f"{at}/_SUCCESS") else lost).append(e["commit"])
    seen = spark.read.schema(STATE).parquet(*[f"{out}/keys/{_folder(k)}" for k in whole]) if whole else spark.createDataFrame([], STATE)
    if lost:
        seen = seen.union(_signed(spark.read.schema("text string").json([f"{out}/data/{_folder(k)}" for k in lost]), job))
    return seen


def judge(rows: DataFrame, seen: DataFrame, job: UnitJob) -> tuple[DataFrame, DataFrame]:
    """Rows (path, pos, text) that are new, cleaned, with exact_key and sig; and the counts (reason, n) of all."""
    gated = quality.web_gate(rows, job.gate, job.normalize).select("path", "pos", F.coalesce("clean_text", F.lit("")).alias("text"), "reason")
    judged = dedup.checkpointed(gated.withColumn("place", F.struct("path", "pos")))
    passed = judged.where(F.col("reason") == "").drop("reason")
    if job.near:
        unique = dedup.near_dedup(passed, job.threshold, job.min_chars, "place", "chars")
    else:
        unique = dedup.exact_dedup(passed, "place").withColumn("sig", F.lit(None).cast("long"))
    new = dedup.checkpointed(dedup.dedup_against(unique, seen, job.threshold))
    marked = judged.join(new.select("place", F.lit(True).alias("new")), "place", "left")
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("new"), "kept").otherwise("duplicate")
    return new, marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _write(new: DataFrame, out: str, number: int) -> None:
    new.orderBy("path", "pos").select("path", "text").write.mode("overwrite").json(f"{out}/data/{_folder(number)}")


def _write_keys(new: DataFrame, out: str, number: int) -> None:
    new.select("exact_key", "sig").write.mode("overwrite").parquet(f"{out}/keys/{_folder(number)}")


def _commit(spark: SparkSession, out: str, entry: dict) -> None:
    store.write_whole(spark, f"{out}/log/{_folder(entry['commit'])}", json.dumps(entry, ensure_ascii=False, sort_keys=True))


def clean_units(spark: SparkSession, inputs: list[str], out: str | None, job: UnitJob = UnitJob(), limit_units: int | None = None) -> DataFrame:
    """(reason, n) over all units done so far; ``kept``, ``duplicate`` and ``unreadable`` (archives) are reasons, too.

    Units are the files and archive members of ``inputs`` in the order of their names; those of the log are left out, ``limit_units`` takes the first. A text that equals or is near to one kept before, in the order of
    units and of places in them, is a duplicate. Without ``out`` nothing is written and all units are judged as one commit. A file without any bytes is no unit.
    """
    entries = log(spark, out) if out else []
    done = {u for e in entries for u in e["units"]}
    found = sorted(r.path for r in readers.units(spark, inputs, members=True).select("path").collect())  # names, no contents
    todo = [u for u in found[:limit_units] if u not in done]
    step = job.at_once if out else max(1, len(todo))
    for k in range(0, len(todo), step):
        number, mine = len(entries), todo[k : k + step]
        rows = spark.createDataFrame([], "path string, pos long, text string")
        for u in mine:
            rows = rows if u.endswith("!") else rows.unionByName(read_unit(spark, u, job.keys))
        new, counts = judge(rows, state(spark, out, entries, job) if out else spark.createDataFrame([], STATE), job)
        entry = {"commit": number, "units": mine, "counts": {r.reason: r.n for r in counts.collect()}}
        if unreadable := sum(u.endswith("!") for u in mine):
            entry["counts"]["unreadable"] = unreadable
        if out:
            _write(new, out, number)
            _write_keys(new, out, number)
            _commit(spark, out, entry)
        entries.append(entry)
    totals: dict[str, int] = {}
    for e in entries:
        for reason, n in e["counts"].items():
            totals[reason] = totals.get(reason, 0) + n
    return spark.createDataFrame(sorted(totals.items()), "reason string, n long")


def kept_texts(spark: SparkSession, out: str) -> DataFrame:
    """(path, text) of what the logged commits kept; what a commit without an entry left behind isn't read."""
    folders = [f"{out}/data/{_folder(e['commit'])}" for e in log(spark, out)]
    return spark.read.schema("path string, text string").json(folders) if folders else spark.createDataFrame([], "path string, text string")
