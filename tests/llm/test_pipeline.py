import corpus_pipeline
from lakecorpus.llm.common import cut, table
from test_line_dedup import brute
from tokenizers import Tokenizer

AT = "/root/testdata/sf0.001"


def words(text):
    import re

    return re.findall(r"\w+", (text or "").lower())


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_and_run(spark):
    import public_tokenizers

    docs = table(spark, AT, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], AT), "test", listed=False))
    rows = [{r.doc_id: r for r in d.collect()} for d in kept]
    for d in kept[:-1]:
        assert d.columns == docs.columns
    # quality: what stays is unchanged and passes the base rule
    assert set(rows[1]) < set(rows[0]) and all(rows[1][k] == rows[0][k] for k in rows[1])
    # lines: the number of lines left is that of the brute force; what is emptied goes
    gone = brute([(k, r.text.lower()) for k, r in rows[1].items()])  # lines are compared in lower case
    for k, r in rows[1].items():
        left = len(r.text.split("\n")) - gone[k]
        assert (k in rows[2]) == (left > 0)
        if left > 0:
            assert len(rows[2][k].text.split("\n")) == left and rows[2][k].n_chars == (len(rows[2][k].text) if gone[k] else r.n_chars)
    # near duplicates: no two of the kept are near, and whatever went is near to something that was there
    sets = {k: grams(r.text) for k, r in rows[2].items()}
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    stays = sorted(rows[3])
    assert not [(a, b) for i, a in enumerate(stays) for b in stays[i + 1 :] if sets[a] and near(a, b)]
    assert all(any(near(k, o) for o in sets if o != k) for k in set(rows[2]) - set(rows[3]))
    # decontamination: by containment of five-word shingles
    items = [grams(r.text) for r in table(spark, AT, "benchmark").collect()]
    for k, r in rows[3].items():
        mine = grams(r.text)
        assert (k in rows[4]) != any(10 * len(mine & i) >= 8 * len(i) for i in items)
    # encoding
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.ids == library.encode(rows[4][k].text, add_special_tokens=False).ids for k, r in rows[5].items())
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, AT).collect()} == {(k, r.n_tokens) for k, r in rows[5].items()}


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, AT), "test", listed=False)
    docs.collect()
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, AT), "test", listed=False)
    assert empty.count() == 0
