"""Result tables as CSV or Markdown text: lines are column expressions, files are written by the partitions of a global order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str, decimals: int | None = None) -> Column:
    """A value as text: null empty, no number "nan", others with ``decimals`` places where given."""
    c = F.col(name)
    if decimals is None:
        return F.coalesce(c.cast("string"), F.lit(""))
    text = F.format_string(f"%.{decimals}f", c.cast("double"))
    return F.when(c.isNull(), "").when(F.isnan(c.cast("double")), "nan").otherwise(text)


def csv_line(cells: Sequence[Column]) -> Column:
    """Cells with commas, quotes or line breaks are quoted, quotes doubled."""
    quoted = [F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat_ws(",", *quoted)


def markdown_line(cells: Sequence[Column]) -> Column:
    """A table row: backslashes and pipes are escaped, line breaks become <br>."""
    plain = [F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\\r\\n|\\r|\\n", "<br>") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def _write(df: DataFrame, path: str, head: str, line: Column, order: Sequence[str]) -> None:
    # The heading is a row before all others in the order that the files are cut by, so it comes once and first.
    body = df.select(F.lit(1).alias("_part"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], line.alias("value"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(df.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(head).alias("value"))
    keys = ["_part", *[f"_o{i}" for i in range(len(order))], "value"]
    first.unionByName(body).orderBy(*keys).select("value").write.option("lineSep", "\n").text(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str], decimals: Mapping[str, int] | None = None) -> None:
    """``df`` as CSV below ``path``: part files in the order of ``order``, the heading at the top of the first, and Spark's ``_SUCCESS`` once all are there.

    Nothing passes the driver; a lost task writes its part anew. Cells may hold any text, line breaks included. An empty table gives the heading alone.
    """
    cells = [cell(df, c, (decimals or {}).get(c)) for c in df.columns]
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in df.columns)
    _write(df, path, head, csv_line(cells), order)


def write_markdown(df: DataFrame, path: str, order: Sequence[str], decimals: Mapping[str, int] | None = None, right: Sequence[str] = (), title: str | None = None) -> None:
    """``df`` as a Markdown table in files as those of ``write_csv``, ``right`` naming the columns set to the right."""
    cells = [cell(df, c, (decimals or {}).get(c)) for c in df.columns]
    rule = "|" + "|".join("---:" if c in right else "---" for c in df.columns) + "|"
    names = "| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|") for c in df.columns) + " |"
    _write(df, path, (f"# {title}\n\n" if title else "") + names + "\n" + rule, markdown_line(cells), order)
