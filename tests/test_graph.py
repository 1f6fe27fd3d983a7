import pytest
from lakecorpus.plans import graph as G
from lakecorpus.sources import store


def test_a_changed_leaf_reruns_its_descendants_alone(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.txt").write_text(f"{n} one\n{n} two\n")
    made = []

    def read(spark, inputs, out):
        made.append(out.rpartition("/")[2])
        rows = spark.read.text(list(inputs.values()))
        rows.write.mode("overwrite").text(out)
        return rows.count()

    def stages(settings=()):
        leaf = [G.Stage(f"raw_{n}", read, files=(str(tmp_path / n),)) for n in "abc"]
        return [G.Stage("all", read, after=("clean_ab", "clean_c")), G.Stage("clean_ab", read, after=("raw_a", "raw_b"), settings=settings), G.Stage("clean_c", read, after=("raw_c",)), *leaf]

    def go(stages, **options):
        made.clear()
        return {r.stage: r.state for r in G.run(spark, stages, str(tmp_path / "out"), **options).collect()}

    every = {"raw_a", "raw_b", "raw_c", "clean_ab", "clean_c", "all"}
    assert set(go(stages(), dry_run=True).values()) == {G.WOULD} and not made and not (tmp_path / "out").exists()
    assert go(stages()) == dict.fromkeys(every, G.MADE) and made.index("raw_a") < made.index("clean_ab") < made.index("all") == 5
    assert go(stages()) == dict.fromkeys(every, G.REUSED) and not made
    (tmp_path / "c/deep").mkdir()
    (tmp_path / "c/deep/y.txt").write_text("more\n")
    got = go(stages(), dry_run=True)
    assert {s for s, x in got.items() if x == G.WOULD} == {"raw_c", "clean_c", "all"} and not made
    go(stages())
    assert set(made) == {"raw_c", "clean_c", "all"}
    go(stages(settings=(1,)))
    assert set(made) == {"clean_ab", "all"}
    store.delete(spark, str(tmp_path / "out/clean_c"))  # a lost result is made again
    go(stages(settings=(1,)))
    assert made == ["clean_c"]
    assert set(go(stages(settings=(1,)), force=True).values()) == {G.MADE}
    assert set(go(stages(settings=(1,)), only=("clean_c",))) == {"raw_c", "clean_c"}


def test_one_branch_fails_alone(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    good = lambda spark, inputs, out: spark.range(3).write.mode("overwrite").parquet(out)

    def bad(spark, inputs, out):
        spark.range(3).write.mode("overwrite").parquet(out)  # written, but not finished
        raise RuntimeError("no luck")

    stages = [G.Stage("a", good, files=(str(tmp_path / "a.txt"),)), G.Stage("b", bad), G.Stage("c", good, after=("b",)), G.Stage("d", good, files=(str(tmp_path / "none"),)), G.Stage("e", lambda *_: 0), G.Stage("f", good, after=("a",))]
    for _ in range(2):
        got = {r.stage: (r.state, r.error) for r in G.run(spark, stages, str(tmp_path / "out")).collect()}
        assert got["b"] == (G.FAILED, "RuntimeError: no luck") and got["c"] == (G.BLOCKED, "b") and got["d"][0] == G.MISSING and got["e"][0] == G.EMPTY
    assert got["a"][0] == got["f"][0] == G.REUSED
    with pytest.raises(ValueError):
        G.signatures(spark, [G.Stage("a", good, after=("z",))])
    with pytest.raises(ValueError):
        G.signatures(spark, [G.Stage("a", good, after=("b",)), G.Stage("b", good, after=("a",))])
    with pytest.raises(ValueError):
        G.signatures(spark, [stages[0], stages[0]])
