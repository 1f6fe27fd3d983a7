import hashlib

import public_tokenizers
from lakecorpus.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "Hello, World! it's I'LL don't", "a  b\u3000c\x1cd<|endoftext|>Hi<|startoftext|> <|endoftext", "ΑΣ ΟΔΟΣ İstanbul \ufb01 é",
    "aaaaaaa aaaa aaa aa", "12345 \xbd ٣ 日本語 \U0001f600\U0001f600!!!???", "\ufeff\x00 \x85 x\xa0y", "'" * 50 + "a" * 999, "word " * 3000,
]


def test_equals_the_library(docs_of):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode(docs_of(TEXTS), PATH, decoded=True).collect()}
    for k, text in enumerate(TEXTS):
        want = library.encode(text, add_special_tokens=False).ids
        assert got[k].ids == want
        assert got[k].decoded == library.decode(want, skip_special_tokens=False)


def test_query(spark):
    from lakecorpus.llm.queries import queries

    at = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = queries()["op6_bpe"](spark, at).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_decode(odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (1, 2, 6))
    assert bpe.encode(odd_docs.limit(0), PATH).count() == 0


def test_the_table_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 10)
    b, library = bpe.WordBPE(PATH), Tokenizer.from_file(PATH)
    for k in range(5):
        text = " ".join(f"word{i}x{k}" for i in range(30)) + "<|endoftext|>"
        assert b.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(b.known) < 50


def test_long_words(monkeypatch):
    """A word of any length equals the library, in time about in proportion to it, and the rounds of one word equal those of all."""
    import random
    import time

    rng = random.Random(3)
    b, library = bpe.WordBPE(PATH), Tokenizer.from_file(PATH)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (2001, 40_000, 80_000)] + ["a" * 50_001, "é" * 3000, "ab" * 20_000]
    t = time.process_time()
    got = [b.encode([x])[0].tolist() for x in long]
    assert time.process_time() - t < 15
    assert got == [library.encode(x, add_special_tokens=False).ids for x in long]
    text = f"some {long[0]} words {'a' * 3001} here"
    assert b.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    alone = bpe.WordBPE(PATH)
    for x in TEXTS:
        assert alone.encode([x])[0].tolist() == library.encode(x, add_special_tokens=False).ids
