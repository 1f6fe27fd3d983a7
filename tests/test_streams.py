import json
import random

import pytest
from lakecorpus.sources import store
from lakecorpus.streaming import detokenize as D
from lakecorpus.streaming import status as S
from pyspark.sql import functions as F

ROWS = "doc_id long, seq long, ids array<int>"
TEXTS = {1: "plain text", 2: "ᠮᠣᠩᠭᠣᠯ 字母 😀 é", 3: "", 4: "x" * 300, None: "no key"}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def told(spark, batches, tmp_path, idle_ms=None, **trigger):
    """(key, text) of a stream that takes a file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    out = D.detokenize(stream, idle_ms=idle_ms)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(**(trigger or {"availableNow": True})).start()
    return q, lambda: {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text")).collect()}


def test_any_batches_and_any_order(rocks, tmp_path):
    pick = random.Random(1)
    rows = []
    for key, text in TEXTS.items():
        data = list(text.encode())
        cuts = sorted(pick.sample(range(len(data) + 1), min(len(data), 7)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rows += [(key, k, p) for k, p in enumerate(parts)] + [(key, len(parts), None)]
    rows += [(9, 0, [0xE5, 0xAD]), (9, 1, [0x41]), (9, 2, [0xF0, 0x9F]), (9, 3, None)]
    pick.shuffle(rows)
    batches = [rows[k::5] for k in range(5)]
    batches[4] = batches[4] + batches[0][:3]  # some come again
    q, result = told(rocks, batches, tmp_path)
    q.awaitTermination(180)
    assert q.exception() is None
    got = result()
    want = {k: t for k, t in TEXTS.items() if t} | {9: bytes([0xE5, 0xAD, 0x41, 0xF0, 0x9F]).decode("utf-8", "replace")}
    assert {k: got.get(k) for k in want} == want


def test_a_timer_tells_the_rest_of_a_silent_key(rocks, tmp_path):
    rows = [(1, 0, list("字".encode())[:2]), (2, 1, [66]), (2, 0, [65]), (2, 3, [67])]
    q, result = told(rocks, [rows], tmp_path, idle_ms=500, processingTime="1 second")
    want = {1: "�", 2: "ABC"}
    for _ in range(60):
        q.awaitTermination(1)
        try:
            if result() == want:
                break
        except Exception:  # nothing is written yet
            continue
    q.stop()
    assert result() == want


def test_pieces():
    table = D._BYTES
    assert D.pieces([(0, list("é".encode())[:1]), (1, list("é".encode())[1:]), (2, None)], 0, b"", table) == ([(0, ""), (1, "é"), (2, "")], 3, b"", True)
    assert D.pieces([(4, [65, 999, -1])], 4, b"", table)[0] == [(4, "A")]


def test_stop_ends_a_stream_after_its_batch(spark, tmp_path):
    monitor = f"file://{tmp_path}/monitor"
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"x": k}) + "\n")

    def run(ask):
        seen, saved = [], []
        control = S.Control(spark, monitor, {"save": saved.append})

        def batch(df, n):
            seen.extend(r.x for r in df.collect())
            if n == ask:
                S.request(spark, monitor, "save", "stop", "save")
                text = json.loads(store.read(spark, f"{monitor}/control.json"))
                store.write_whole(spark, f"{monitor}/control.json", json.dumps({"commands": [*text["commands"], "stop", "fly"]}))

        stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(control.wrap(batch)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        return control.wait(q), seen, saved

    log = S.ProgressLog(spark, monitor, keep=3, about={"run": 1, "rate": float("nan")})
    spark.streams.addListener(log)
    try:
        stopped, first, saved = run(1)
        assert stopped and len(first) == 2 and saved == [1] and not store.exists(spark, f"{monitor}/control.json")
        stopped, rest, _ = run(None)
        assert not stopped and sorted(first + rest) == list(range(5))
        import time

        for _ in range(300):  # reports come some time after what they are about
            now = S.read_status(spark, monitor) or {}
            if now.get("batch") == 4 and now["state"] == "finished" and len(S.read_history(spark, monitor)) == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    status = S.read_status(spark, monitor)
    assert status["batch"] == 4 and status["state"] == "finished" and status["about"] == {"run": 1, "rate": None}
    assert [r["batch"] for r in S.read_history(spark, monitor)] == [2, 3, 4]
    assert [r["batch"] for r in S.read_history(spark, monitor, last=2)] == [3, 4]
    again = S.ProgressLog(spark, monitor, keep=2)
    assert len(again.rows) == 2  # history goes on


def test_commands(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    assert S.take_commands(spark, at) == [] and S.read_status(spark, at) is None and S.read_history(spark, at) == []
    with pytest.raises(ValueError):
        S.request(spark, at, "fly")
    S.request(spark, at, "eval")
    S.request(spark, at, "save", "eval")
    assert S.take_commands(spark, at) == ["eval", "save"] and S.take_commands(spark, at) == []
    store.write_whole(spark, f"{at}/control.json", "{broken")
    assert S.take_commands(spark, at) == []
    store.write_whole(spark, f"{at}/control.json", json.dumps({"commands": "stop"}))
    assert S.take_commands(spark, at) == []
    with pytest.raises(ValueError):
        S.ProgressLog(spark, at, keep=0)
