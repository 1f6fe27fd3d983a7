from lakecorpus.operators import preferences as P
from pyspark.sql import functions as F

HEAD = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
TURNS = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "Why é?"), (2, 0, "system", None), (2, 1, "user", "x"), (3, 0, "user", "no answer"), (None, 0, "user", "null key")]
ANSWERS = [(1, "Because.", "No"), (2, "y", ""), (4, "alone", "also"), (5, None, "z"), (None, "a", "b")]


def plain(conv, answer):
    ids, mask = [256], [0]
    for c, _, role, text in [t for t in TURNS if t[0] == conv] + [(conv, 9, "assistant", answer)]:
        head, body = list(HEAD[role].encode()), list((text or "").encode())
        says = role == "assistant"
        ids += head + body + ([257] if says else [10])
        mask += [0] * len(head) + [int(says)] * (len(body) + 1)
    return ids, mask


def tables(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"), spark.createDataFrame(ANSWERS, "conv_id long, chosen string, rejected string")


def test_both_answers_share_the_context(spark):
    got = {r.conv_id: r for r in P.preference_examples(*tables(spark)).collect()}
    assert set(got) == {1, 2, 4, None}
    for conv, chosen, rejected in ANSWERS:
        if chosen is not None:
            assert (got[conv].chosen_ids, got[conv].chosen_mask) == plain(conv, chosen)
            assert (got[conv].rejected_ids, got[conv].rejected_mask) == plain(conv, rejected)
    cut = {r.conv_id: r for r in P.preference_examples(*tables(spark), limit=12).collect()}
    assert cut[1].chosen_ids == plain(1, "Because.")[0][-12:] and cut[1].chosen_mask == plain(1, "Because.")[1][-12:]
    assert P.preference_examples(tables(spark)[0], tables(spark)[1].limit(0)).count() == 0


def test_prompts_lose_their_beginning(spark):
    whole = {r.conv_id: r.prompt_ids for r in P.prompt_ids(tables(spark)[0], bos=256).collect()}
    assert whole[3] == [256, *b"<|user|>\nno answer\n<|assistant|>\n"]
    cut = {r.conv_id: r.prompt_ids for r in P.prompt_ids(tables(spark)[0], limit=20, bos=256).collect()}
    assert all(cut[k] == whole[k][-20:] for k in whole)


def test_sides_are_padded_apart(spark):
    rows = P.preference_examples(*tables(spark)).where("conv_id IN (1, 2)").withColumn("batch", F.lit(0))
    (r,) = P.collate_pairs(rows, "batch", 0).collect()
    for side, answers in (("chosen", ("Because.", "y")), ("rejected", ("No", ""))):
        want = [plain(k, a) for k, a in zip((1, 2), answers, strict=True)]
        n = max(len(i) for i, _ in want)
        assert r[f"{side}_ids"] == [i + [0] * (n - len(i)) for i, _ in want]
        assert r[f"{side}_mask"] == [m + [0] * (n - len(m)) for _, m in want]
        assert r[f"{side}_attention"] == [[1] * len(i) + [0] * (n - len(i)) for i, _ in want]
