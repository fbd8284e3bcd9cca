"""Structured Streaming for arriving input decks: quiet-period debounce and live burn counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(changes: DataFrame, quiet: str = "5 seconds", late: str = "1 minute", path: str = "path", at: str = "modified") -> DataFrame:
    """One row for each burst of changes of a path that a quiet period ends.

    ``changes`` streams or is static. The session closes once the watermark passes its end; later rows of it are dropped.
    """
    marked = changes.withWatermark(at, late) if changes.isStreaming else changes
    s = marked.groupBy(F.col(path), F.session_window(F.col(at), quiet).alias("s")).agg(F.count("*").alias("changes"), F.max(at).alias("last"))
    return s.select(path, "s.start", "s.end", "changes", "last")


def live_counts(cells: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Tumbling counts of burned cells by event time."""
    marked = cells.withWatermark(at, late) if cells.isStreaming else cells
    return marked.groupBy(F.window(F.col(at), width).alias("w"), "i", "j").agg(F.count("*").alias("burn_count")).select("w.start", "w.end", "i", "j", "burn_count")


def allowed(path, white_list: list[str]):
    """Whether a path holds any entry of a white list."""
    return F.exists(F.array(*map(F.lit, white_list)), lambda entry: F.contains(path, entry)) if white_list else F.lit(False)
