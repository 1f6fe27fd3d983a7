import json
import zipfile
from dataclasses import replace

import pytest
from lakecorpus.operators.quality import WebConfig
from lakecorpus.plans import jobs, units
from lakecorpus.sources import readers, store
from pyspark.sql import functions as F

GOOD = "市政府今天宣布了新的公共交通规划。根据这份规划，未来五年内将新建三条地铁线路，并对现有的公交网络进行全面优化。专家认为，这些措施能够有效缓解城市拥堵，改善居民的出行体验，也有助于减少空气污染。"
OTHER = "春天来了，公园里的樱花竞相开放，吸引了众多市民和游客前来观赏拍照。孩子们在草坪上奔跑嬉戏，老人们在长椅上悠闲地晒着太阳聊着家常。湖面上荡漾着几只小船，岸边的柳枝随风轻轻摆动，构成一幅生机盎然的画面。"
JOB = units.UnitJob(gate=WebConfig(min_chars=60), keys=("Content",), min_chars=80)


def write(path, texts, key="Content"):
    path.write_text("".join(json.dumps({key: t}, ensure_ascii=False) + "\n" for t in texts))
    return str(path)


def texts_of(spark, out):
    """All bytes of the texts that count, commit after commit, in the order of their files."""
    found = []
    for e in units.log(spark, out):
        at = f"{out}/data/commit-{e['commit']:06d}"
        found.append("".join(open(f"{at}/{n}", encoding="utf-8").read() for n in store.names(spark, at) if n.startswith("part-") and n.endswith(".json")))
    return found


@pytest.fixture
def inputs(tmp_path):
    write(tmp_path / "a.jsonl", [GOOD, GOOD, "太短", "hello world " * 40])
    write(tmp_path / "b.jsonl", [OTHER, GOOD, OTHER.replace("春天", "春天")])
    write(tmp_path / "c.jsonl", [])
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("y.jsonl", json.dumps({"Content": OTHER + "另外一段完全不同的文字被加在后面，" * 6}, ensure_ascii=False))
        z.writestr("x.jsonl", json.dumps({"Content": GOOD}, ensure_ascii=False) + "\n{broken\n")
    (tmp_path / "e.zip").write_bytes(b"PK no archive")
    return str(tmp_path)


def totals(df):
    return {r.reason: r.n for r in df.collect()}


def test_all_units_under_one_deduplication(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    got = totals(units.clean_units(spark, [inputs], out, JOB))
    assert got == {"kept": 3, "duplicate": 4, "too_short": 1, "low_script": 1, "unreadable": 1}
    done = [u for e in units.log(spark, out) for u in e["units"]]
    assert [u.rpartition("/")[2] for u in done] == ["a.jsonl", "b.jsonl", "d.zip!x.jsonl", "d.zip!y.jsonl", "e.zip!"]
    before = texts_of(spark, out)
    assert totals(units.clean_units(spark, [inputs], out, JOB)) == got and texts_of(spark, out) == before  # nothing to do
    assert units.kept_texts(spark, out).count() == 3
    assert totals(units.clean_units(spark, [inputs], None, JOB)) == got  # only the counts


@pytest.mark.parametrize("step", ["_write", "_write_keys", "_commit"])
def test_a_run_broken_off_goes_on_with_the_same_bytes(spark, inputs, tmp_path_factory, monkeypatch, step):
    whole, broken = (str(tmp_path_factory.mktemp(n)) for n in ("whole", "broken"))
    job = replace(JOB, near=False)
    want = totals(units.clean_units(spark, [inputs], whole, job))
    plain, calls = getattr(units, step), []

    def killed(*args):
        """Every second commit is broken off at this step: before it, then after it."""
        calls.append(1)
        if len(calls) % 4 == 2:
            raise InterruptedError
        plain(*args)
        if len(calls) % 4 == 0:
            raise InterruptedError

    monkeypatch.setattr(units, step, killed)
    runs = 0
    while True:
        runs += 1
        try:
            got = totals(units.clean_units(spark, [inputs], broken, job))
            break
        except InterruptedError:
            continue
    assert runs > 2 and got == want and texts_of(spark, broken) == texts_of(spark, whole)


def test_state_is_made_anew_from_texts(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    units.clean_units(spark, [inputs], out, JOB, limit_units=2)
    kept = sorted(map(tuple, units.state(spark, out, units.log(spark, out), JOB).collect()))
    store.delete(spark, f"{out}/keys")
    assert sorted(map(tuple, units.state(spark, out, units.log(spark, out), JOB).collect())) == kept and len(kept) == 2
    assert totals(units.clean_units(spark, [inputs], out, JOB))["kept"] == 3


def test_archives_are_read_member_by_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("two.jsonl", "".join(json.dumps({"text": f"line {k}"}) + "\n" for k in range(2500)))
        z.writestr("one.txt", "a whole text\nof two lines")
        z.writestr("no.bin", "x")
    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    members = readers.zip_members(spark, str(tmp_path)).collect()
    assert {(r.member, r.bad) for r in members} == {("two.jsonl", False), ("one.txt", False), ("no.bin", False), (None, True)}
    rows = readers.read_zip(spark, str(tmp_path)).orderBy("pos").collect()
    assert len({r.pos for r in rows}) == 2501 and rows[0].text == "a whole text\nof two lines" and [r.text for r in rows[1:]] == [f"line {k}" for k in range(2500)]
    assert readers.read_zip(spark, str(tmp_path), member="one.txt").count() == 1


def test_bad_files_are_marked(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": "one"}, {"x": ""}]')
    (tmp_path / "b.json").write_text('[{"x": "one"')
    (tmp_path / "c.json").write_text('{"text": "one more"}')
    (tmp_path / "d.json").write_text("[" * 200_000)
    got = readers.read_json_array(spark, str(tmp_path), ("x",), mark_bad=True).collect()
    assert {r.path.rpartition("/")[2] for r in got if r.bad} == {"b.json", "d.json"} and [r.text for r in got if not r.bad] == ["one"]
    assert readers.read_json_array(spark, str(tmp_path), ("x",)).count() == 1
    got = readers.read_json_documents(spark, str(tmp_path), mark_bad=True).collect()
    assert {r.path.rpartition("/")[2] for r in got if r.bad} == {"b.json", "d.json"} and [r.text for r in got if not r.bad] == ["c\none more"]


def test_layout_is_told_from_the_first_file_alone(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/a.json").write_text(" \n[1]")
    (tmp_path / "b.json").write_text("{}")
    assert readers.sniff_json(spark, str(tmp_path)) == "array" and readers.sniff_json(spark, str(tmp_path / "b.json")) == "jsonl"


def test_freshness_sees_deep_files_and_lost_results(spark, tmp_path):
    deep = tmp_path / "in/x/y"
    deep.mkdir(parents=True)
    write(deep / "a.jsonl", [f"aaaa {i} " * 5 for i in range(20)], "text")
    sources = [jobs.MixSource(str(tmp_path / "in/x/y/a.jsonl"), 1.0), jobs.MixSource(str(tmp_path / "in"), 1.0, format="jsonl")]
    now = jobs.signature(spark, sources)
    write(deep / "b.jsonl", ["bbbb"], "text")
    assert jobs.signature(spark, sources) != now
    out = str(tmp_path / "mix")
    run = lambda: jobs.build_mixture(spark, sources[:1], out, skip_if_fresh=True)
    assert run() is not None and run() is None
    store.delete(spark, out)
    assert run() is not None and spark.read.json(out).count() > 0


def test_near_texts_of_the_state_are_dropped(spark):
    from lakecorpus.operators import dedup

    signed = spark.createDataFrame([("a", 0b1011), ("b", -1), ("c", None), ("d", 7)], "exact_key string, sig long")
    state = spark.createDataFrame([("x", 0b1000), ("d", None), ("y", None), ("z", 0b1000)], "exact_key string, sig long")
    for threshold in (0, 2, 3):
        got = {r.exact_key for r in dedup.dedup_against(signed, state, threshold).collect()}
        assert got == {"b", "c"} | ({"a"} if threshold < 2 else set()), threshold
