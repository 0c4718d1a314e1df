"""Tag reading responses (JSON) to text and structured hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx

PAYLOAD = (
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>, "
    "promptFeedback struct<blockReason:string>"
)
TAG = (
    "text string, brand string, model_numbers array<string>, sizes array<string>, "
    "materials array<string>, made_in string"
)


def read_responses(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``status, error, text, brand, model_numbers, sizes, materials, made_in``.

    ``status``: ``ok``; ``text_only`` where the answer is not JSON but readable; ``blocked`` and
    ``empty`` where it cannot be used, with the reason in ``error``. No row is dropped.
    """
    keys = responses.columns
    opened = responses.select("*", F.from_json(payload, PAYLOAD).alias("p"))
    parts = F.get(F.col("p.candidates"), F.lit(0))["content"]["parts"]
    joined = F.array_join(F.transform(parts, lambda part: F.coalesce(part["text"], F.lit(""))), "")
    answered = opened.select(
        *keys,
        F.nullif(F.col("p.promptFeedback.blockReason"), F.lit("")).alias("block"),
        F.coalesce(joined, F.lit("")).alias("answer"),
    ).select(
        "*",
        F.try_parse_json("answer").isNotNull().alias("is_json"),
        F.from_json("answer", TAG).alias("tag"),
    )
    usable = F.col("block").isNull() & (tx.strip_raw(F.col("answer")) != "")
    as_json = usable & F.col("is_json")
    head, tail = dims.BLOCKED_RESPONSE.split("{}")

    def word(name: str) -> Column:
        return F.when(as_json, F.nullif(tx.strip_raw(F.col(f"tag.{name}")), F.lit("")))

    def words(name: str) -> Column:
        tidy = F.filter(F.transform(F.col(f"tag.{name}"), tx.strip_raw), lambda w: w != "")
        return F.when(as_json, F.coalesce(tidy, F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>"))

    return answered.select(
        *keys,
        F.when(F.col("block").isNotNull(), F.lit("blocked"))
        .when(~usable, F.lit("empty"))
        .when(F.col("is_json"), F.lit("ok")).otherwise(F.lit("text_only")).alias("status"),
        F.when(F.col("block").isNotNull(), F.concat(F.lit(head), F.col("block"), F.lit(tail)))
        .when(~usable, F.lit(dims.EMPTY_RESPONSE)).alias("error"),
        F.when(as_json, tx.strip_raw(F.coalesce(F.col("tag.text"), F.lit(""))))
        .when(usable, tx.strip_raw(F.col("answer"))).alias("text"),
        word("brand").alias("brand"),
        words("model_numbers").alias("model_numbers"),
        words("sizes").alias("sizes"),
        words("materials").alias("materials"),
        word("made_in").alias("made_in"),
    )
