"""Token-budget rewriting of fill-in-the-middle prompts: block stripping, left trim, variants, conflict policy, ledger."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import FILE_SEP, FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX, fim_in_order, let
from millrace.storage import materialize

#: The closed list of reasons.
MISSING_FIELDS = "missing_required_fields"
MIN_COMPLETION = "min_completion_tokens"
COMPLETION_TOO_LONG = "completion_too_long"
LOST_AFTER_TRUNCATION = "fim_tokens_lost_after_truncation"
LOST_AFTER_STRIP = "fim_tokens_lost_after_strip"
BUDGET_TOO_SMALL = "budget_too_small_for_fim"
OVER_MODEL_MAX = "prompt_exceeds_model_max_length"
MAX_ITERS = "hit_file_sep_max_iters"
MAX_CALLS = "hit_max_tokenize_calls_per_example"
SKIPPED_CHAR_LEN = "skipped_file_sep_pass_due_to_char_len"
NEEDS_TRUNCATION = "rag_variant_requires_truncation"
BOTH_MODE_CONFLICT = "both_mode_conflict_skip"

UNKNOWN_MODEL_MAX = 1_000_000
FIM_TOKENS = (FIM_PREFIX, FIM_SUFFIX, FIM_MIDDLE)
#: The tokens of the default tokenizer: markers, runs of blanks, words, single other characters.
TOKEN = r"<\|[a-z_]+\|>|\s+|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"


@dataclass(frozen=True)
class ConvertOptions:
    max_length: int = 2048
    eos_len: int = 1
    policy: str = "drop_file_sep_prefix_then_left"  # or "left"
    truncate: bool = True
    min_completion_tokens: int = 1
    max_iters: int = 128
    max_strip_chars: int = 300_000
    drop_on_safeguard: bool = True
    model_max_length: int | None = None
    enforce_model_max: bool = False
    variants: tuple[str, str] = ("norag", "rag")
    rag_requires_truncation: bool = False
    conflict: str = "keep_one"  # or "skip"


def split_tokens(text: Column) -> Column:
    """Tokens of the default tokenizer; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def token_count(text: Column, tokens: Callable[[Column], Column] = split_tokens) -> Column:
    """How many tokens a text has; those of the default tokenizer, which cover the text, become one character each and are not made."""
    return F.length(F.regexp_replace(text, TOKEN, "x")) if tokens is split_tokens else F.size(tokens(text))


def separators(text: Column) -> Column:
    return F.call_function("regexp_count", text, F.lit(FILE_SEP.replace("|", r"\|")))


def strip_blocks(prompt: Column, prefix_only: bool = False, max_iters: int = 128) -> Column:
    """Struct (text, removed, unmatched, hit_max): file-separator blocks taken out from the left, pair by pair.

    Stops when no pair is left, at a lone marker (unmatched), at the prefix token if prefix_only, before a removal that
    would lose a fill-in-the-middle token, or after max_iters removals. The text is cut at the markers once; at most
    max_iters pairs are folded, and the last part that holds each token is looked up once, so the cost is linear in the text.
    """
    sep = FILE_SEP.replace("|", r"\|")
    return let(F.split(prompt, sep, -1), lambda parts: let(_last_parts(parts), lambda last: _fold_blocks(parts, last, prefix_only, max_iters)))


def _last_parts(parts: Column) -> Column:
    """For each token the last part that holds it, -1 if none does."""

    def last_part(token: str) -> Column:
        return F.array_max(F.transform(parts, lambda x, i: F.when(x.contains(token), i).otherwise(-1)))

    return F.array(*map(last_part, FIM_TOKENS))


def _fold_blocks(parts: Column, last: Column, prefix_only: bool, max_iters: int) -> Column:
    pairs = F.least(F.floor((F.size(parts) - 1) / 2).cast("int"), F.lit(max_iters))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("removed"), F.lit(False).alias("stop"))

    def step(acc: Column, k: Column) -> Column:
        return let(F.concat(acc["kept"], parts[2 * k]), lambda head: let(acc["stop"] | ends(head, k), lambda stop: after(acc, k, head, stop)))

    def ends(head: Column, k: Column) -> Column:
        joined = F.concat(head, parts[2 * k + 2])  # a token may come together where the block goes
        whole = functools.reduce(lambda a, b: a & b, [(last[n] > 2 * k + 2) | joined.contains(t) for n, t in enumerate(FIM_TOKENS)])
        return (head.contains(FIM_PREFIX) | ~whole) if prefix_only else ~whole

    def after(acc: Column, k: Column, head: Column, stop: Column) -> Column:
        as_is = F.concat(head, F.lit(FILE_SEP), parts[2 * k + 1], F.lit(FILE_SEP))
        return F.struct(F.when(stop, as_is).otherwise(head).alias("kept"), (acc["removed"] + F.when(stop, 0).otherwise(1)).alias("removed"), stop.alias("stop"))

    def told(done: Column) -> Column:
        tail = F.array_join(F.slice(parts, 2 * pairs + 1, F.size(parts)), FILE_SEP)
        hit = done["removed"] >= max_iters
        lone = (F.size(parts) % 2 == 0) & ~done["stop"] & ~hit
        return F.struct(F.concat(done["kept"], tail).alias("text"), done["removed"].alias("removed"), lone.cast("int").alias("unmatched"), hit.alias("hit_max"))

    numbers = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.aggregate(numbers, start, step), told)


def left_trim(prompt: Column, budget: Column, tokens: Callable[[Column], Column] = split_tokens) -> Column:
    """Struct (text, removed, reason): tokens before the prefix token are dropped until the budget holds."""
    return let(_trimmed(prompt, budget, tokens), lambda t: F.struct(t["text"].alias("text"), t["removed"].alias("removed"), t["reason"].alias("reason")))


def _trimmed(prompt: Column, budget: Column, tokens: Callable[[Column], Column]) -> Column:
    """left_trim with total, the number of tokens that there were."""

    def told(total: Column, cut: Column) -> Column:
        excess = total - budget
        before = token_count(F.substring_index(prompt, FIM_PREFIX, 1), tokens)
        reason = F.when(excess <= 0, None).when(~prompt.contains(FIM_PREFIX), LOST_AFTER_TRUNCATION).when(excess > before, BUDGET_TOO_SMALL).when(~fim_in_order(cut), LOST_AFTER_TRUNCATION)
        return let(reason, lambda why: F.struct(
            F.when(excess <= 0, prompt).when(why.isNull(), cut).alias("text"), F.when((excess > 0) & why.isNull(), excess).otherwise(0).alias("removed"), why.alias("reason"), total.alias("total")
        ))

    def cut(made: Column) -> Column:
        left = F.slice(made, F.greatest(F.size(made) - budget, F.lit(0)) + 1, F.greatest(budget, F.lit(0)))
        return F.struct(F.size(made).alias("total"), F.array_join(left, "").alias("cut"))

    return let(let(tokens(prompt), cut), lambda c: told(c["total"], c["cut"]))


def truncate(df: DataFrame, opts: ConvertOptions, prompt: str = "prompt", completion_tokens: str = "completion_tokens", tokens: Callable[[Column], Column] = split_tokens) -> DataFrame:
    """Adds t: struct (text, removed, reason, skipped_strip, hit_max, over_budget, total) by the policy; total is the tokens before."""
    budget = F.lit(opts.max_length) - F.col(completion_tokens) - opts.eos_len
    text = F.col(prompt)
    d = df.withColumn("__budget", budget).withColumn("__n", token_count(text, tokens))
    fits = F.col("__n") <= F.col("__budget")
    needs = ~fits & (F.col("__budget") > 0)
    if opts.policy == "drop_file_sep_prefix_then_left":
        small = F.length(text) <= opts.max_strip_chars
        d = d.withColumn("__ts", F.when(needs & small, strip_blocks(text, True, opts.max_iters)))
        d = d.withColumn("__p", F.coalesce(F.col("__ts.text"), text)).withColumn("__hit", F.coalesce(F.col("__ts.hit_max"), F.lit(False))).withColumn("__skipped", needs & ~small)
    else:
        d = d.withColumn("__p", text).withColumn("__hit", F.lit(False)).withColumn("__skipped", F.lit(False))
    d = d.withColumn("__t", F.when(needs, _trimmed(F.col("__p"), F.col("__budget"), tokens)))
    stripped = F.greatest(F.lit(0), F.col("__n") - F.coalesce(F.col("__t.total"), F.col("__n")))
    reason = (
        F.when(F.col("__budget") <= 0, COMPLETION_TOO_LONG).when(fits, None).when(~fim_in_order(text), LOST_AFTER_TRUNCATION)
        .when(F.col("__hit") & F.lit(opts.drop_on_safeguard), MAX_ITERS).otherwise(F.col("__t.reason"))
    )
    out = F.struct(F.when(fits & (F.col("__budget") > 0), text).otherwise(F.col("__t.text")).alias("text"), F.when(fits, 0).otherwise(stripped + F.coalesce(F.col("__t.removed"), F.lit(0))).alias("removed"), reason.alias("reason"), F.col("__skipped").alias("skipped_strip"), F.col("__hit").alias("hit_max"), needs.alias("over_budget"), F.col("__n").alias("total"))
    return d.withColumn("t", out).drop("__budget", "__n", "__ts", "__p", "__hit", "__t", "__skipped")


def fan_out(df: DataFrame, opts: ConvertOptions) -> DataFrame:
    """Each row once for each variant: the first has all blocks stripped, the second none."""
    plain, rag = opts.variants
    return df.withColumn("variant", F.explode(F.array(F.lit(plain), F.lit(rag))))


def convert(df: DataFrame, opts: ConvertOptions = ConvertOptions(), split: str = "split", tokens: Callable[[Column], Column] = split_tokens) -> DataFrame:
    """Every (row, variant) with its new prompt or its drop_reason, after the conflict policy.

    df: prompt, completion, source_id, split and whatever else is to be carried. Adds variant, variant_id, drop_reason,
    tokens_before, tokens_after, removed_tokens, truncated, removed_blocks. Rows with missing fields are told as such.
    """
    typed = df.withColumn("completion_tokens", token_count(F.coalesce("completion", F.lit("")), tokens))
    plain, rag = opts.variants
    d = fan_out(typed, opts).withColumn("__prompt", F.coalesce("prompt", F.lit("")))
    is_plain = F.col("variant") == plain
    d = d.withColumn("__s", F.when(is_plain, strip_blocks(F.col("__prompt"), False, opts.max_iters)))
    hit = F.coalesce(F.col("__s.hit_max"), F.lit(False))
    d = d.withColumn("__base", F.when(is_plain & ~hit, F.col("__s.text")).otherwise(F.col("__prompt")))
    d = truncate(d, opts, "__base", tokens=tokens) if opts.truncate else d.withColumn("t", F.struct(F.col("__base").alias("text"), F.lit(0).alias("removed"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("skipped_strip"), F.lit(False).alias("hit_max"), F.lit(False).alias("over_budget"), token_count(F.col("__base"), tokens).alias("total")))
    as_before = (F.col("t.text") == F.col("__base")) & F.col("t.text").isNotNull()
    d = d.withColumn("tokens_before", F.col("t.total")).withColumn("tokens_after", F.when(as_before, F.col("t.total")).otherwise(token_count(F.col("t.text"), tokens)))
    limit = opts.model_max_length if opts.model_max_length and opts.model_max_length <= UNKNOWN_MODEL_MAX else None
    reason = F.when(F.col("prompt").isNull() | F.col("completion").isNull(), MISSING_FIELDS).when(F.col("completion_tokens") < opts.min_completion_tokens, MIN_COMPLETION)
    if opts.rag_requires_truncation and not opts.truncate:
        reason = reason.when(F.col("variant") == rag, NEEDS_TRUNCATION)
    if opts.drop_on_safeguard:
        reason = reason.when(hit, MAX_ITERS)
    reason = reason.when(is_plain & ~fim_in_order(F.col("__base")), LOST_AFTER_STRIP).when(F.col("t.reason").isNotNull(), F.col("t.reason"))
    if opts.truncate:  # a prompt that has been through the budget is looked at before the model's limit
        reason = reason.when(~fim_in_order(F.col("t.text")), LOST_AFTER_TRUNCATION)
    if opts.enforce_model_max and limit:
        reason = reason.when(F.col("tokens_after") > limit, OVER_MODEL_MAX)
    reason = reason.when(~fim_in_order(F.col("t.text")), LOST_AFTER_TRUNCATION)
    d = materialize(d.withColumn("drop_reason", reason), "convert-judged").withColumn("removed_blocks", F.coalesce(F.col("__s.removed"), F.lit(0)))
    guards = {"hit_max_iters": F.coalesce(F.col("__s.hit_max"), F.lit(False)) | F.col("t.hit_max"), "skipped_strip": F.col("t.skipped_strip"), "unmatched": F.coalesce(F.col("__s.unmatched"), F.lit(0)) > 0, "over_budget": F.col("t.over_budget")}
    d = d.withColumns(guards)
    d = d.withColumn("over_model_max", (F.col("tokens_before") > limit) if limit else F.lit(False))
    d = d.withColumn("prompt", F.when(F.col("drop_reason").isNull(), F.col("t.text"))).withColumn("removed_tokens", F.col("t.removed")).withColumn("truncated", F.col("drop_reason").isNull() & (F.col("t.removed") > 0))
    d = d.withColumn("variant_id", F.concat_ws("::", F.col("source_id").cast("string"), "variant")).drop("__prompt", "__s", "__base", "t")
    return conflict_policy(d, opts)


def conflict_policy(df: DataFrame, opts: ConvertOptions) -> DataFrame:
    """keep_one keeps what passed; skip drops the survivor of a source of which another variant failed. Adds emitted (0 to 2)."""
    w = Window.partitionBy("source_id")
    ok = F.count_if(F.col("drop_reason").isNull()).over(w)
    d = df.withColumn("emitted", ok)
    if opts.conflict == "skip":
        lone = F.col("drop_reason").isNull() & (F.col("emitted") < len(opts.variants))
        d = d.withColumn("drop_reason", F.when(lone, BOTH_MODE_CONFLICT).otherwise(F.col("drop_reason"))).withColumn("prompt", F.when(lone, None).otherwise(F.col("prompt")))
        d = d.withColumn("emitted", F.when(F.col("emitted") < len(opts.variants), 0).otherwise(F.col("emitted")))
    return d


def drop_ledger(converted: DataFrame, split: str = "split") -> DataFrame:
    """(split, variant, reason, n) with a total over splits, whose split is null."""
    dropped = converted.filter("drop_reason is not null")
    return dropped.groupingSets([[F.col(split), F.col("variant"), F.col("drop_reason")], [F.col("variant"), F.col("drop_reason")]], split, "variant", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def drop_maps(converted: DataFrame, split: str = "split") -> DataFrame:
    """(split, drop_reasons: map, drop_reasons_by_variant: map of maps); the total has a null split."""
    ledger = drop_ledger(converted, split)
    by_variant = ledger.groupBy(split, "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "n")))).alias("m"))
    nested = by_variant.groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", F.map_entries("m").alias("m"))))).alias("e"))
    flat = ledger.groupBy(split, "drop_reason").agg(F.sum("n").alias("n")).groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "n")))).alias("drop_reasons"))
    return flat.alias("a").join(nested.alias("b"), F.col(f"a.{split}").eqNullSafe(F.col(f"b.{split}"))).select(F.col(f"a.{split}").alias(split), "drop_reasons", F.transform_values("e", lambda _, v: F.map_from_entries(v)).alias("drop_reasons_by_variant"))


def emission_tally(converted: DataFrame) -> DataFrame:
    """Sources by how many of their variants were emitted."""
    return converted.groupBy("source_id").agg(F.max("emitted").alias("emitted")).groupBy("emitted").agg(F.count(F.lit(1)).alias("sources"))


def split_stats(converted: DataFrame, split: str = "split") -> DataFrame:
    """Counts and averages of each split and of all (split null); averages have the denominators of their own meaning.

    safeguard columns: rows that hit the limit of removals, skipped the pass for their length, or had a lone marker.
    """
    kept, n = F.col("drop_reason").isNull(), F.count(F.lit(1))
    return converted.groupingSets([[F.col(split)], []], split).agg(
        n.alias("total_seen"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(F.col("truncated")).alias("truncated"), F.sum("removed_blocks").alias("removed_blocks"),
        F.max("tokens_before").alias("max_tokens_before"), F.max(F.when(kept, F.col("tokens_after"))).alias("max_tokens_after"), F.count_if(F.col("over_model_max")).alias("over_model_max"), F.count_if(F.col("over_budget")).alias("over_budget"),
        (F.sum("tokens_before") / n).alias("avg_tokens_before"), (F.sum(F.when(kept, F.col("tokens_after"))) / F.greatest(F.lit(1), F.count_if(kept))).alias("avg_tokens_after"),
        (F.sum("completion_tokens") / n).alias("avg_completion_tokens"), F.max("completion_tokens").alias("max_completion_tokens"), F.sum(F.when(kept, F.col("removed_tokens")).otherwise(0)).alias("removed_tokens"),
        F.count_if(F.col("hit_max_iters")).alias("hit_max_iters"), F.count_if(F.col("skipped_strip")).alias("skipped_strip"), F.count_if(F.col("unmatched")).alias("unmatched_markers"),
    )
