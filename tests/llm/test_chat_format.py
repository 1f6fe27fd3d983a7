import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from lakecorpus.llm import chat_format as cf

CONFIG = cf.ChatConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"))
pieces = st.sampled_from([*cf.CONTROL, "<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", " ", "a", "é"])


@given(st.lists(pieces, max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = cf.escape(text)
    assert cf.unescape(out) == text
    assert not any(c in out for c in cf.CONTROL)


def test_reads_back(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(7, 2, "assistant", "first " + said), (7, 0, "system", "be [ROLE] kind"), (7, 1, "user", None), (7, 3, "assistant", ""), (7, 4, "</s>", "odd role"), (8, None, None, "x"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = cf.format_chat(df, CONFIG)
    rows = {r.conv_id: r for r in cf.digests(formatted, CONFIG).collect()}
    want = {}
    for conv in (7, 8, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1] if t[1] is not None else -1)
        parts = [(t[2] or "", t[3] or "") for t in mine]
        loss = "".join(t for r, t in parts if r == "assistant")
        chars = 3 + sum(17 + len(cf.escape(r)) + len(cf.escape(t)) for r, t in parts)
        want[conv] = (len(parts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for k, r in rows.items()} == want
    ids = cf.reserved(CONFIG.ranks)
    seven = formatted.where("conv_id = 7").orderBy("seq").collect()
    assert seven[0].ids == [ids["<s>"]] and [r.ids[0] for r in seven[1:]] == [ids["[ROLE]"]] * 5
    assert [any(r.loss) for r in seven] == [False, False, False, True, False, False]
    assert cf.digests(cf.format_chat(df.limit(0), CONFIG), CONFIG).count() == 0
