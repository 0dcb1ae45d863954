"""Event signals from sentences, and gates that give a reason for each rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T


def first_signals(docs: DataFrame, rules: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """(id, seq, signal): the first rule, in order, that each sentence matches."""
    rows = docs.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("seq", "sentence"))
    signal = F.coalesce(*(F.when(F.col("sentence").rlike(p), F.lit(name)) for name, p in rules))
    return rows.select(id_col, "seq", signal.alias("signal")).where(F.col("signal").isNotNull())


def gate(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """The rows with ``reason``: of the first condition that holds (null as false), or 'pass'."""
    cascade = F.lit("pass")
    for name, condition in reversed(reasons):
        cascade = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(cascade)
    return rows.withColumn("reason", cascade)
