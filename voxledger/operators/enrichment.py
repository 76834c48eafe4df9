"""Model enrichment as a table job: build prompts, run any scorer, apply answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import labels as L
from voxledger.functions.text import is_blank, truncate
from voxledger.operators.batching import consecutive_batches
from voxledger.session import materialize_buckets, ship_by_value

ship_by_value(__name__)

BATCH_PROMPT = (
    "Label each feedback item of a digital product.\n\n{items}\n\n"
    "Answer with a JSON array of exactly {count} objects, in input order, each with "
    '"category" (Bug, Feature Request, Complaint, Spam or Praise), '
    '"sentiment" (Positive, Neutral or Negative) and "urgency_score" (1 to 5).'
)
ROW_PROMPT = (
    'Label this feedback on a digital product: "{text}"\n\n'
    'Answer with one JSON object with "category" (Bug, Feature Request, Complaint, Spam or Praise), '
    '"sentiment" (Positive, Neutral or Negative) and "urgency_score" (1 to 5).'
)
TITLE_PROMPT = (
    "Write a specific title of 3 to 8 words for an incident with these reports:\n\n{samples}\n\n"
    "Answer with the title only."
)
TITLE_SAMPLES = 5

# What batches are grouped by; rows of a chunk lie together.
BATCH = ("chunk", "batch_id")

# From prompts (a key and ``prompt``) to answers (the key and ``response``), as a frame.
# A scorer may hand on ``chunk``.
Scorer = Callable[[DataFrame], DataFrame]


def _fill(template: str, **parts: Column) -> Column:
    text = F.lit(template)
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def micro_batches(df: DataFrame, size: int = S.BATCH_SIZE) -> DataFrame:
    """Consecutive chunks of ``size`` rows in id order: ``batch_id``, 0-based ``pos``, and the ``chunk`` a batch lies in."""
    return consecutive_batches(df, "id", size)


def with_item_number(batched: DataFrame) -> DataFrame:
    """1-based number of each non-blank row within its batch; null for blank rows."""
    filled = ~is_blank(F.col("clean_text"))
    upto = Window.partitionBy(*BATCH).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batched.withColumn("item", F.when(filled, F.count_if(filled).over(upto).cast("int")))


def keep_batches(numbered: DataFrame) -> DataFrame:
    """The rows written once, in a bucket per chunk, so that prompts are built where the texts lie."""
    return materialize_buckets(numbered, "chunk", "batches", S.TEXTS)


def build_batch_prompts(batched: DataFrame, chars: int = S.BATCH_TEXT_CHARS) -> DataFrame:
    """One prompt per batch from its non-blank texts; batches of blanks have none."""
    texts = batched.filter(~is_blank(F.col("clean_text"))).select(
        *BATCH, F.struct("pos", truncate(F.col("clean_text"), chars).alias("text")).alias("t")
    )
    lines = F.transform(
        F.array_sort("texts"),
        lambda t, i: F.concat((i + 1).cast("string"), F.lit('. "'), t["text"], F.lit('"')),
    )
    grouped = texts.groupBy(*BATCH).agg(F.collect_list("t").alias("texts"))
    return grouped.select(
        *BATCH,
        F.size("texts").alias("item_count"),
        F.array_join(lines, "\n").alias("items"),
    ).withColumn("prompt", _fill(BATCH_PROMPT, count=F.col("item_count").cast("string"), items=F.col("items")))


def build_row_prompts(df: DataFrame, chars: int = S.SINGLE_TEXT_CHARS) -> DataFrame:
    """One prompt per non-blank row."""
    text = truncate(F.col("clean_text"), chars)
    return df.filter(~is_blank(F.col("clean_text"))).select("id", _fill(ROW_PROMPT, text=text).alias("prompt"))


def build_title_prompts(tickets: DataFrame) -> DataFrame:
    """One prompt per ticket that has samples."""
    lines = F.transform(F.slice("sample_reviews", 1, TITLE_SAMPLES), lambda s: F.concat(F.lit("- "), s))
    samples = F.array_join(lines, "\n")
    some = tickets.filter(F.size("sample_reviews") > 0)
    return some.select("ticket_key", samples.alias("samples")).withColumn(
        "prompt", _fill(TITLE_PROMPT, samples=F.col("samples"))
    )


def answering(
    answer: Callable[[list[str]], list[str | None]], parallelism: int | None = None, key: str = "batch_id"
) -> Scorer:
    """A scorer from a function that answers a list of prompts.

    Each Arrow batch of prompts is one call. Where a call fails, its prompts are
    tried one by one, and one that still fails has a null answer; the job goes on.
    ``parallelism`` bounds how many calls run at once. Throttling belongs inside
    the function.
    """

    def alone(prompt: str) -> str | None:
        try:
            return answer([prompt])[0]
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = list(frame["prompt"])
            try:
                answers = answer(asked)
                if len(answers) != len(asked):
                    raise ValueError("one answer per prompt")
            except Exception:
                answers = [alone(prompt) for prompt in asked]
            yield frame.drop(columns="prompt").assign(response=pd.Series(answers, dtype=object, index=frame.index))

    def score(prompts: DataFrame) -> DataFrame:
        keys = [c for c in ("chunk", key) if c in prompts.columns]
        wanted = prompts.select(*keys, "prompt")
        if parallelism:
            wanted = wanted.repartition(parallelism)
        shape = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in keys)
        return wanted.mapInPandas(run, f"{shape}, response string")

    return score


def _spread(df: DataFrame, label: Column) -> DataFrame:
    kept = [c for c in df.columns if c not in ("category", "sentiment", "urgency_score")]
    return df.withColumn("_label", F.coalesce(label, L.fallback_label())).select(*kept, "_label.*")


def apply_batch_responses(numbered: DataFrame, responses: DataFrame) -> DataFrame:
    """Give every row the label at its place in the answer of its batch.

    Blank rows, rows beyond a short answer and all rows of a failed batch get
    the fallback. ``responses`` has at most one row per batch.
    """
    keys = [c for c in BATCH if c in responses.columns]
    parsed = responses.select(*keys, L.labels_from_array(F.col("response")).alias("_labels"))
    joined = numbered.join(parsed, keys, "left")
    label = F.when(F.col("item").isNotNull(), F.get("_labels", F.col("item") - 1))
    return _spread(joined, label).drop("_labels")


def classify_rows(df: DataFrame, responses: DataFrame) -> DataFrame:
    """Labels from answers by ``id``; blank rows and failures get the fallback.

    All rows of an id share its answer, also rows without an id where there is an
    answer without one; of several answers to one id the least by text counts, so no
    row is multiplied.
    """
    one = responses.groupBy("id").agg(F.min("response").alias("response"))
    label = L.labels_from_object(F.col("response")).alias("_found")
    answers = one.select(F.col("id").alias("_id"), label)
    joined = df.join(answers, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return _spread(joined, F.when(~is_blank(F.col("clean_text")), F.col("_found"))).drop("_found")


def route_empty_text(df: DataFrame) -> DataFrame:
    """Mark rows whose text is blank; they skip the model and carry the fallback label."""
    blank = is_blank(F.col("clean_text"))
    label = F.when(blank, L.fallback_label())
    return df.withColumn("needs_model", ~blank).withColumn("_label", label).select(
        *df.columns,
        "needs_model",
        F.col("_label.category").alias("category"),
        F.col("_label.sentiment").alias("sentiment"),
        F.col("_label.urgency_score").alias("urgency_score"),
    )
