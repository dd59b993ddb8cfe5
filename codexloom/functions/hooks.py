"""Hooks for user functions over text, with deterministic offline defaults."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def map_text(df: DataFrame, prompt: str, fn: Callable[[list[str | None]], list[str]] | None, out: str, default: str = "", client: Callable | None = None, retries: int = 0,
             pause: float = 0.0, audit: Observation | None = None) -> DataFrame:
    """df with ``out`` = fn over batches of prompts, and ``out_error``.

    A batch that fails is tried row by row; a row that fails is tried ``retries`` times more, with growing pauses (seconds), then gets the
    default and its error's name. ``client``, instead of fn, is called once per partition and returns the
    function: connections are set up there. ``audit`` counts n_rows and n_failed while the result is computed.
    """

    def one(call: Callable, text: str | None) -> tuple[str, str | None]:
        for again in range(retries + 1):
            try:
                return call([text])[0], None
            except Exception as e:  # noqa: BLE001  a user function may raise anything; it must not fail the job
                error = type(e).__name__
            if again < retries and pause:
                time.sleep(pause * 2**again)
        return default, error

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = fn
        for b in batches:
            if call is None and len(b):
                call = client()
            texts = [None if pd.isna(x) else x for x in b[prompt]]
            errors = [None] * len(texts)
            try:
                got = list(call(texts)) if texts else []
                if len(got) != len(texts):
                    raise ValueError("one result per prompt is needed")
            except Exception:  # noqa: BLE001
                rows = [one(call, t) for t in texts]
                got, errors = [r[0] for r in rows], [r[1] for r in rows]
            yield b.assign(**{out: got, f"{out}_error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    made = df.mapInPandas(emit, f"{schema}, `{out}` string, `{out}_error` string")
    return made if audit is None else made.observe(audit, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"{out}_error").isNotNull()).alias("n_failed"))


def lead_words(texts: list[str | None], limit: int = 200) -> list[str]:
    """The first ``limit`` words of each text: the default summary."""
    return [" ".join((t or "").split()[:limit]) for t in texts]


def lead_sentences(text: Column, limit: int = 200) -> Column:
    """The default summary as an expression: the first ``limit`` blank-separated words."""
    # a piece may be empty before the first word, and the last one holds the rest of the text
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+", limit + 2), lambda w: w != ""), 1, limit), " ")


def embed(df: DataFrame, text: str, dims: int = 256) -> DataFrame:
    """df with ``embedding``: hashed term weights of unit length, from Spark's own feature stages.

    An empty table has no weights to fit; it gets the column and stays empty.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    if df.isEmpty():
        return df.withColumn("embedding", F.lit(None).cast("array<float>"))
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))
    flow = Pipeline(stages=[Tokenizer(inputCol="_text", outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
                            IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")])
    got = flow.fit(df).transform(df)
    return got.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_text", "_words", "_tf", "_idf", "_unit")
