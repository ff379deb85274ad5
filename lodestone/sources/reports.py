"""Reports of metric tables as JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(rows: DataFrame, title: str, order: str, most: int = 1000) -> DataFrame:
    """One row (report): a Markdown table of the first `most` rows by `order`."""
    text = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), " | "), F.lit(" |"))
    lines = rows.orderBy(order).limit(most).select(F.col(order).alias("__o"), text.alias("line"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(head), body).alias("report"))


def write_report(rows: DataFrame, path: str, title: str, order: str) -> None:
    """`path`/json (all rows) and `path`/markdown (one text file)."""
    base = path.rstrip("/")
    rows.write.mode("overwrite").json(f"{base}/json")
    markdown(rows, title, order).coalesce(1).write.mode("overwrite").text(f"{base}/markdown")
