"""Preference examples of conversations: one context, an answer that is preferred and one that isn't, as two rows with masks; prompts cut from the left; batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import SUPERVISED, generation_prompts, sft_rows
from .training_rows import IGNORE, byte_ids, pad, truncate

SIDES = ("chosen", "rejected")


def preference_examples(context: DataFrame, answers: DataFrame, limit: int | None = None, bos: int = 256, eos: int = 257, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, chosen_ids, chosen_mask, rejected_ids, rejected_mask) from turns (conv_id, turn, role, text) and answers (conv_id, chosen, rejected).

    Both rows begin with the context; the mask is 1 on what an assistant says and its end tokens. With ``limit`` each row is cut so that the end of its answer stays. An answer may
    stand without a context; a context without an answer is left out, and so is an answer that is null. conv_id is unique among the answers.
    """
    key = F.col(conversation)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in SIDES]))
    said = answers.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).select(key.alias("_c"), sides.alias("s"))
    # an answer comes behind all turns, so it is one turn later than the last
    last = context.groupBy(conversation).agg(F.max("turn").alias("_last"))
    ends = said.join(last, F.col("_c").eqNullSafe(last[conversation]), "left").select(F.struct("_c", "s.side").alias("_key"), (F.coalesce("_last", F.lit(-1)) + 1).cast("long").alias("turn"), F.lit(SUPERVISED).alias("role"), "s.text")
    begins = context.join(answers.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).select(key.alias("_c")), F.col("_c").eqNullSafe(context[conversation])).select("_c", F.explode(F.array(*map(F.lit, SIDES))).alias("side"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = begins.select(F.struct("_c", "side").alias("_key"), "turn", "role", "text").union(ends)
    rows = sft_rows(turns, bos, eos, "_key")
    rows = rows if limit is None else truncate(rows, limit)
    masked = rows.select("_key", F.struct("ids", F.transform("labels", lambda x: F.when(x == IGNORE, 0).otherwise(1)).alias("mask")).alias("r"))
    both = masked.groupBy(F.col("_key._c").alias(conversation)).agg(*[F.max(F.when(F.col("_key.side") == s, F.col("r"))).alias(s) for s in SIDES])
    return both.select(conversation, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in SIDES for c in ("ids", "mask")])


def prompt_ids(turns: DataFrame, limit: int | None = None, bos: int | None = None, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, prompt_ids): what a model goes on from, the assistant's header at its end. With ``limit`` the last so many ids: a long prompt loses its beginning."""
    ids = byte_ids(F.col("prompt"))
    ids = ids if bos is None else F.concat(F.array(F.lit(bos)), ids)
    out = generation_prompts(turns, conversation).select(conversation, ids.alias("_ids"))
    n = F.size("_ids")
    kept = F.col("_ids") if limit is None else F.slice("_ids", F.greatest(n - limit, F.lit(0)) + 1, F.lit(limit))
    return out.select(conversation, kept.alias("prompt_ids"))


def collate_pairs(rows: DataFrame, batch: str, pad_id: int, position: str = "conv_id") -> DataFrame:
    """(batch, and for each side ids, mask and attention): the rows of a batch in order, each side padded to its own longest. Attention is 1 where an id isn't the padding. A batch is small by its purpose."""
    longest = rows.groupBy(batch).agg(*[F.max(F.size(f"{s}_ids")).alias(f"_{s}") for s in SIDES])
    d = rows.join(longest, batch)

    def padded(s: str) -> list[Column]:
        return [pad(F.col(f"{s}_ids"), F.col(f"_{s}"), pad_id).alias(f"{s}_ids"), pad(F.col(f"{s}_mask"), F.col(f"_{s}"), 0).alias(f"{s}_mask")]

    one = F.struct(F.col(position).alias("at"), *[c for s in SIDES for c in padded(s)])
    d = d.groupBy(batch).agg(F.array_sort(F.collect_list(one)).alias("r"))
    attention = lambda ids: F.transform(ids, lambda row: F.transform(row, lambda x: (x != pad_id).cast("int")))
    return d.select(batch, *[c for s in SIDES for c in (F.col("r")[f"{s}_ids"].alias(f"{s}_ids"), F.col("r")[f"{s}_mask"].alias(f"{s}_mask"), attention(F.col("r")[f"{s}_ids"]).alias(f"{s}_attention"))])
