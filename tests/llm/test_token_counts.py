import numpy as np
import public_tokenizers
from lakecorpus.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_equal_the_encoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = tc.encoding(RANKS)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, tc.TokenFileConfig(RANKS, block=1 << 10)).collect()}
    assert got == want


def test_scan_stitches_any_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = {"a": rng.choice([7, 8, 9], 500, p=[0.02, 0.49, 0.49]), "b": np.full(90, 8), "c": np.full(20, 7), "d": np.array([], dtype=int), "e": np.array([8, 7])}
    paths = []
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
        paths.append((f"file://{tmp_path}/{name}",))
    want = set()
    for name, ids in files.items():
        docs, n = [], 0
        for x in ids:
            if x == 7:
                docs.append((n, True))
                n = 0
            else:
                n += 1
        docs += [(n, False)] if n else []
        want |= {(name, k, *d) for k, d in enumerate(docs)}
    for block in (2, 6, 64, 4096):
        rows = tc.scan(spark.createDataFrame(paths, "path string"), tc.TokenFileConfig(RANKS, end=7, block=block)).collect()
        got = [(r.path.rpartition("/")[2], r.ordinal, r.n_tokens, r.ended) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(odd_docs):
    rows = tc.count_tokens(odd_docs, tc.TokenFileConfig(RANKS)).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert tc.count_tokens(odd_docs.limit(0), tc.TokenFileConfig(RANKS)).count() == 0


def test_files_go_with_the_cuts(docs_of, spark):
    import os

    from lakecorpus.llm.common import drop_cuts, shared_dir

    at = shared_dir(spark).removeprefix("file://") + "/lakecorpus"
    drop_cuts(spark)
    before = set(os.listdir(at))
    counted = tc.count_tokens(docs_of(["a few words", "more of them"]), tc.TokenFileConfig(RANKS))
    assert counted.count() == 2 and any(f.startswith("tokens-") for f in set(os.listdir(at)) - before)
    drop_cuts(spark)
    assert set(os.listdir(at)) <= before
