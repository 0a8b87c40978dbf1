"""Spans around plans: Spark's job descriptions, and OpenTelemetry where it is installed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@contextmanager
def trace(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside carry ``name``."""
    try:
        from opentelemetry import trace as otel

        span = otel.get_tracer("larkspur").start_as_current_span(name)
    except ImportError:
        span = nullcontext()
    spark.sparkContext.setJobDescription(name)
    try:
        with span:
            yield
    finally:
        spark.sparkContext.setJobDescription(None)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are computed while it runs, at no further pass."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
