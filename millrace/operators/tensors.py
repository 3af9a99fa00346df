"""Rows of token ids for training: truncation, label masks, padding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def truncate_pair(prompt: Column, completion: Column, max_length: int, eos_len: int = 1) -> tuple[Column, Column]:
    """Ids cut to max_length with the end token: the prompt from the left first, then the completion from the right."""
    over = F.greatest(F.lit(0), F.size(prompt) + F.size(completion) + eos_len - max_length)
    from_prompt = F.least(over, F.size(prompt))
    left = F.slice(prompt, from_prompt + 1, F.size(prompt) - from_prompt)
    keep = F.greatest(F.lit(0), F.size(completion) - (over - from_prompt))
    return left, F.slice(completion, 1, keep)


def truncatable(df: DataFrame, completion: str = "completion_ids", max_length: int = 2048, eos_len: int = 1) -> DataFrame:
    """Rows that still have a completion token after truncation."""
    return df.filter((F.size(completion) > 0) & F.lit(max_length > eos_len))


def label_rows(df: DataFrame, max_length: int, eos_id: int, prompt: str = "prompt_ids", completion: str = "completion_ids") -> DataFrame:
    """Adds input_ids, attention_mask and labels; the prompt's labels are ignored. Rows left without completion are dropped."""
    p, c = truncate_pair(F.col(prompt), F.col(completion), max_length)
    end = F.array(F.lit(eos_id).cast("long"))
    d = df.withColumn("__p", p.cast("array<long>")).withColumn("__c", c.cast("array<long>")).filter(F.size("__c") > 0)
    d = d.withColumn("input_ids", F.concat("__p", "__c", end)).withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), F.size("__p")), F.col("__c"), end))
    return d.withColumn("attention_mask", F.array_repeat(F.lit(1).cast("long"), F.size("input_ids"))).drop("__p", "__c")


def pad_batches(df: DataFrame, order: str, batch_size: int, pad_id: int) -> DataFrame:
    """Adds batch and pads each row on the right to its batch's longest.

    Batches are consecutive rows of `order`, a dense number of the rows from 0.
    """
    d = df.withColumn("batch", F.floor(F.col(order) / batch_size))
    d = d.withColumn("__n", F.max(F.size("input_ids")).over(Window.partitionBy("batch")) - F.size("input_ids"))
    for name, fill in (("input_ids", pad_id), ("attention_mask", 0), ("labels", IGNORE)):
        d = d.withColumn(name, F.concat(F.col(name), F.array_repeat(F.lit(fill).cast("long"), F.col("__n"))))
    return d.drop("__n")


def training_steps(rows: int, batch_size: int, accumulation: int, epochs: float, warmup_ratio: float = 0.0) -> dict[str, int]:
    per_epoch = math.ceil(rows / (batch_size * accumulation))
    steps = max(1, int(per_epoch * epochs))
    return {"steps_per_epoch": per_epoch, "total_steps": steps, "warmup_steps": int(steps * warmup_ratio)}
