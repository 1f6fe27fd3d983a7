"""Chat rows of conversations: rendering, supervision, preference pairs, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakecorpus.functions import metrics as M
from lakecorpus.functions import textnorm as N

from .training_rows import IGNORE, byte_ids

#: Headers of the roles; only what an assistant says is supervised (fixed values).
HEADERS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n", "tool": "<|tool|>\n"}
SUPERVISED = "assistant"


def header(role: Column) -> Column:
    """The role's header; an unknown role raises."""
    out = F.when(F.lit(False), "")
    for name, text in HEADERS.items():
        out = out.when(role == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string"))


def spans(turns: DataFrame) -> DataFrame:
    """Adds head and body to each turn. All but the assistant's end with a line feed; those end with the end token."""
    text = F.coalesce("text", F.lit(""))
    return turns.withColumn("head", header(F.col("role"))).withColumn("body", F.when(F.col("role") == SUPERVISED, text).otherwise(F.concat(text, F.lit("\n"))))


def render(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, rendered, supervised_chars): conversations as text. A conversation is one row, so its length bounds the row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.concat("head", "body").alias("part"))))
    chars = F.sum(F.when(F.col("role") == SUPERVISED, F.length("body")).otherwise(0))
    return spans(turns).groupBy(conversation).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("rendered"), chars.alias("supervised_chars"))


def sft_rows(turns: DataFrame, bos: int = 256, eos: int = 257, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, ids, labels): byte-level rows. The first token and headers are masked, assistants' texts and their end tokens supervised.

    Conversations without a supervised token are left out.
    """
    head, body = byte_ids(F.col("head")), byte_ids(F.col("body"))
    says = F.col("role") == SUPERVISED
    end = F.when(says, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))
    ids = F.concat(head, body, end)
    masked = F.array_repeat(F.lit(IGNORE), F.size(head) + F.size(body))
    labels = F.when(says, F.concat(F.array_repeat(F.lit(IGNORE), F.size(head)), body, end)).otherwise(masked)
    rows = spans(turns).select(conversation, F.struct("turn", "role", ids.alias("ids"), labels.alias("labels")).alias("t"))
    rows = rows.groupBy(conversation).agg(F.array_sort(F.collect_list("t")).alias("t"))
    joined = lambda c: F.flatten(F.transform("t", lambda s: s[c]))
    out = rows.select(conversation, F.concat(F.array(F.lit(bos)), joined("ids")).alias("ids"), F.concat(F.array(F.lit(IGNORE)), joined("labels")).alias("labels"))
    return out.where(F.exists("labels", lambda x: x != IGNORE))


def generation_prompts(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, prompt): the rendering with the assistant's header behind it."""
    return render(turns, conversation).select(conversation, F.concat("rendered", F.lit(HEADERS[SUPERVISED])).alias("prompt"))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Adds chosen_ids, rejected_ids and prompt_ids of rows (prompt, chosen, rejected); both completions share the prompt's ids."""
    p = byte_ids(F.concat(F.lit(HEADERS["user"]), "prompt", F.lit("\n" + HEADERS[SUPERVISED])))
    return rows.withColumn("prompt_ids", p).withColumns({f"{c}_ids": F.concat("prompt_ids", byte_ids(F.col(c)), F.array(F.lit(257))) for c in ("chosen", "rejected")})


NUMBER = r"-?\d+(?:\.\d+)?"


def exact_reward(response: Column, reference: Column) -> Column:
    return (N.fold_answer(response) == N.fold_answer(reference)).cast("double")


def numeric_reward(response: Column, reference: Column, tolerance: float = 1e-6) -> Column:
    """1 if the last numbers of both are within the tolerance; 0 if one has none."""
    last = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), F.lit(-1)).cast("double")
    return F.coalesce((F.abs(last(response) - last(reference)) <= tolerance).cast("double"), F.lit(0.0))


def purity_reward(text: Column, floor: float = 0.0) -> Column:
    """Share of Cyrillic and traditional Mongolian letters among letters; 0 below the floor."""
    hits = M.count_of(text, rf"[{M.SCRIPTS['cyrillic']}{M.SCRIPTS['mongolian']}]&&\p{{L}}")
    share = M.ratio(hits, M.count_of(text, r"\p{L}"))
    return F.when(share < floor, 0.0).otherwise(share)


def format_reward(text: Column) -> Column:
    """1 if there is one think block and something behind or before it."""
    block = r"(?s)<think>.*?</think>"
    rest = N.strip(F.regexp_replace(text, block, ""))
    return ((M.matches(text, block) == 1) & (rest != "")).cast("double")


def total_reward(response: Column, reference: Column, exact: float = 0.0, numeric: float = 0.0, purity: float = 0.0, purity_floor: float = 0.0, form: float = 0.0) -> Column:
    """The weighted sum; rewards against a null reference count 0."""
    against = exact * exact_reward(response, reference) + numeric * numeric_reward(response, reference)
    return F.coalesce(against, F.lit(0.0)) + purity * purity_reward(response, purity_floor) + form * format_reward(response)


def group_advantages(rows: DataFrame, group: str, reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the group's standard deviation plus eps.

    The group's sums are joined to its rows, so a large group isn't gathered.
    """
    stats = rows.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return rows.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def turns_of(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Conversation, number of turns, turns and characters of each role."""
    by = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"n_{r}")
    return conversations.groupBy(conversation).agg(F.count(F.lit(1)).alias("n_turns"), by("system"), by("user"), by("assistant"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def next_turn(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, response, reference): each assistant's turn with the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    d = conversations.withColumn("reference", F.lag("text").over(w)).where(F.col("role") == SUPERVISED)
    return d.select("conv_id", "turn", F.col("text").alias("response"), "reference")
