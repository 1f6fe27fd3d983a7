import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lakecorpus.plans.prepare import prepare_corpus
from lakecorpus.sources import layouts


def written(spark, out):
    return sorted(r.text for r in spark.read.schema("text string").json(out).collect())


def report(df):
    return {(r.path or "").rpartition("/")[2]: (r.written, r.error) for r in df.collect()}


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")


def test_jsonl(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"body": "hello\nthere"}, "", {"body": ""}, "not json", {"body": "None"}, {"body": "world"}, {"other": 1}])
    out = str(tmp_path / "out")
    got = prepare_corpus(spark, "jsonl", str(tmp_path / "a.jsonl"), out, column="body")
    assert sorted((r.written, r.error) for r in got.collect()) == [(0, "1 broken lines"), (2, None)] and written(spark, out) == ["hello there", "world"]
    prepare_corpus(spark, "jsonl", str(tmp_path / "a.jsonl"), out, column="body", limit=1, append=True)
    assert written(spark, out) == ["hello there", "hello there", "world"]


def test_parquet_and_wiki(spark, tmp_path):
    (tmp_path / "20231101.mn/nested").mkdir(parents=True)
    (tmp_path / "20231101.en").mkdir()
    pq.write_table(pa.table({"text": ["a1", "", "a2"], "id": [1, 2, 3]}), tmp_path / "20231101.mn/a.parquet")
    pq.write_table(pa.table({"id": [4, 5], "text": ["b1", None]}), tmp_path / "20231101.mn/nested/b.parquet")
    (tmp_path / "20231101.mn/c.parquet").write_bytes(b"PAR1 broken")
    pq.write_table(pa.table({"text": ["other"]}), tmp_path / "20231101.en/a.parquet")
    out = str(tmp_path / "out")
    got = report(prepare_corpus(spark, "wiki", str(tmp_path), out, lang="mn"))
    assert written(spark, out) == ["a1", "a2", "b1"] and got["a.parquet"] == (2, None) and got["b.parquet"] == (1, None)
    assert got["c.parquet"][0] == 0 and "Arrow" in got["c.parquet"][1]
    prepare_corpus(spark, "wiki", str(tmp_path / "20231101.mn"), out, lang="xx", limit=2)  # the folder itself
    assert written(spark, out) == ["a1", "a2"]
    pq.write_table(pa.table({"body": ["x"]}), tmp_path / "20231101.mn/d.parquet")
    with pytest.raises(ValueError, match="none of the columns"):
        prepare_corpus(spark, "parquet", str(tmp_path / "20231101.mn"), out)
    with pytest.raises(ValueError, match="no Parquet files"):
        prepare_corpus(spark, "parquet", out, out + "2")
    rows, bad = layouts.read_parquet_files(spark, str(tmp_path / "20231101.mn"), ("text", "body"), need=False)
    assert sorted(r.text for r in rows.collect() if r.text) == ["a1", "a2", "b1", "x"] and [r.path.rpartition("/")[2] for r in bad.collect()] == ["c.parquet"]
    with pytest.raises(ValueError):
        prepare_corpus(spark, "wiki", str(tmp_path), out)
    with pytest.raises(ValueError):
        prepare_corpus(spark, "fax", str(tmp_path), out)


def test_bundle_and_documents(spark, tmp_path):
    root = tmp_path / "zh"
    (root / "JournalArticle2013_2023").mkdir(parents=True)
    (root / "TsinghuaBilingualCorpus").mkdir()
    (root / "人民日报2023.json").write_text(json.dumps([{"title": "题目", "content": "内容"}], ensure_ascii=False))
    lines(root / "问答语料300.json", [{"question": "问", "answer": "答"}, {"question": "null"}])
    (root / "JournalArticle2013_2023/b.json").write_text(json.dumps({"data": [{"title_c": "论文", "keyword_e": "key"}]}, ensure_ascii=False))
    (root / "JournalArticle2013_2023/a.json").write_text("[broken")
    (root / "TsinghuaBilingualCorpus/x.txt").write_text("第一行\n\nsecond line\n", encoding="utf-8")
    out = str(tmp_path / "out")
    prepare_corpus(spark, "bundle", str(root), out)
    assert written(spark, out) == sorted(["内容", "题目", "问", "答", "论文", "key", "第一行", "second line"])
    parts = layouts.read_layout(spark, str(root))
    assert {r.part for r in parts.collect()} == {0, 1, 2, 3}
    assert layouts.read_layout(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        layouts.read_layout(spark, str(root), (layouts.Part("*.json", "pdf"),))
    (tmp_path / "docs/deep").mkdir(parents=True)
    (tmp_path / "docs/a.txt").write_bytes("ᠮᠣᠩᠭᠣᠯ\nᠬᠡᠯᠡ".encode("utf-16"))
    (tmp_path / "docs/deep/b.TXT").write_text("plain")
    (tmp_path / "docs/c.md").write_text("not a text")
    prepare_corpus(spark, "documents", str(tmp_path / "docs"), out)
    assert written(spark, out) == sorted(["ᠮᠣᠩᠭᠣᠯ ᠬᠡᠯᠡ", "plain"])
