import hashlib
import random

import pytest
from lakecorpus.llm import suffix_dedup
from lakecorpus.llm.suffix_dedup import SuffixConfig, remove_repeats


def brute(rows, length=100):
    """rows: (doc_id, text), ids unique and not null."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans, p = [], 0
        while (a := gone.find(1, p)) >= 0:
            p = gone.find(0, a)
            p = len(data) if p < 0 else p
            spans.append((a, p))
        out[d] = (len(data), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


def read(df):
    return {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()}


def adversarial():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([60, 99, 100, 101, 250, 700]))) for _ in range(20)]
    rows = [(0, "a" * 500), (1, "ab" * 300), (2, "é" * 120 + "x"), (3, "a" * 99), (4, "a" * 100), (5, None), (6, "")]
    for d in range(7, 90):
        parts = [rng.choice(base) if rng.random() < 0.8 else "".join(rng.choice("xyz") for _ in range(40)) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["", "-", " "]).join(parts)
        cut = rng.randrange(len(text))
        rows.append((d * 7 % 1000, text[cut:] if rng.random() < 0.3 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("config", [SuffixConfig(), SuffixConfig(gram=16, stretch=300, bucket=3), SuffixConfig(gram=32, bucket=1)])
def test_equals_brute_force(docs_of, config):
    rows = adversarial()
    assert read(remove_repeats(docs_of(rows), config)) == brute(rows)


def test_query_on_a_whole_table(spark):
    from lakecorpus.llm.queries import queries

    at = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()])
    rows = queries()["op8_suffix_dedup"](spark, at).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_odd_rows(odd_docs):
    rows = remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_bytes, len(r.spans)) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    four = [[tuple(s) for s in r.spans] for r in rows if r.doc_id == 4]
    assert four[0] == four[1] == [(15, 135)]
    assert [[tuple(s) for s in r.spans] for r in rows if r.doc_id == 5] == [[(0, 135)]]
    assert remove_repeats(odd_docs.limit(0)).count() == 0


def test_texts_that_share_a_hash(docs_of, monkeypatch):
    """The result is the same where many texts have one first hash."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(12)]
    rows = [*enumerate([*texts, texts[3], texts[5], texts[0][:150] + texts[1][150:]])]
    read = lambda: sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(rows)).collect())
    want = read()
    monkeypatch.setattr(suffix_dedup, "_text_hash", lambda text: suffix_dedup.F.length(text).cast("long"))
    assert read() == want and want[12][1] == b"" and len(want[14][1]) == 0
