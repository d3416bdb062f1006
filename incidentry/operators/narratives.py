"""Summaries and recommendations, by rules or by a caller's text model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions.wording import incident_summary, mitigations, prompt

CONTEXT = ["incident_id", "incident_date", "incident_type", "severity", "location", "carer_id", "notification_delay_days"]


def with_summaries(df: DataFrame, ruleset: str = "basic") -> DataFrame:
    return df.withColumns({"summary": incident_summary(ruleset), "mitigations": mitigations(ruleset)})


def with_model_summaries(
    df: DataFrame, text_model: Callable[[str], str], context: Sequence[str] = tuple(CONTEXT)
) -> DataFrame:
    """``summary`` written by the caller's function from a prompt column; recommendations stay rule-based."""
    asked = df.withColumns({"prompt": prompt(list(context)), "mitigations": mitigations()})
    schema = asked.withColumn("summary", F.lit("")).schema

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(summary=[text_model(text).strip() for text in batch["prompt"]])

    return asked.mapInPandas(answer, schema)
