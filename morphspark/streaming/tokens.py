"""The analyser on streams: it works on rows alone, so a stream takes the same plan; counts by time window come on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.operators.analyzer import Analyzer


def stream_tokens(lines: DataFrame, analyzer: Analyzer, text: str = "value") -> DataFrame:
    """Morpheme rows of a stream of texts."""
    return analyzer.tokens(lines, text)


def windowed_counts(lines: DataFrame, analyzer: Analyzer, time: str, text: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, pos_id, n): morphemes by time window and class; rows later than `late` are dropped."""
    rows = analyzer.tokens(lines.withWatermark(time, late), text, [time])
    return rows.groupBy(F.window(time, window).alias("w"), "pos_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "pos_id", "n")
