"""Report and log sinks: everything is built as columns and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import alert_line, table_cell


def markdown(rows: DataFrame, cells: dict[str, Column], order: list[str]) -> DataFrame:
    """One row, `text`: a Markdown table of the given cells.  For reports of stated size."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(table_cell(c) for c in cells.values())), F.lit(" |"))
    head = "| " + " | ".join(cells) + " |\n|" + "---|" * len(cells)
    keyed = rows.select(F.struct(*order, line.alias("__line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["__line"])
    return keyed.agg(F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def alert_lines(notifications: DataFrame, stamp: Column) -> DataFrame:
    """One line per alert of webhook notifications (status, alerts array)."""
    each = notifications.select(F.col("status").alias("__s"), F.explode("alerts").alias("a"))
    return each.select(alert_line(F.coalesce("a.status", "__s"), F.col("a.labels"), F.col("a.annotations"), stamp).alias("value"))


def append_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def log_run(run: str, params: dict[str, str], scores: DataFrame, path: str) -> None:
    """Append one row (run, params, metrics): the scores of a one-row frame that are not null."""
    metrics = F.map_filter(F.create_map(*(x for c in scores.columns for x in (F.lit(c), F.col(c).cast("double")))), lambda _, v: v.isNotNull())
    held = F.create_map(*(F.lit(x) for kv in params.items() for x in kv)) if params else F.create_map().cast("map<string,string>")
    scores.select(F.lit(run).alias("run"), held.alias("params"), metrics.alias("metrics")).write.mode("append").parquet(path)
