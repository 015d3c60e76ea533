"""Flow rows as comma-separated text, without quotes, as a file or on the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import rust_double


def lines(rows: DataFrame) -> DataFrame:
    """value: one line for each row."""
    parts = [rust_double(F.col(f"`{c}`")) if k in ("double", "float") else F.col(f"`{c}`").cast("string") for c, k in rows.dtypes]
    return rows.select(F.concat_ws(",", *[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))


def write_csv(rows: DataFrame, path: str, header: bool = False) -> None:
    """A folder of text parts, replaced if it is there; the header, if any, stands first in each part, as Spark's writer has it."""
    text = lines(rows)
    if header:
        text = text.withColumnRenamed("value", ",".join(rows.columns))
        text.write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)
    else:
        text.write.mode("overwrite").text(path)


def show(rows: DataFrame, header: bool = False) -> None:
    """Prints every row, one partition at a time."""
    if header:
        print(",".join(rows.columns))
    for r in lines(rows).toLocalIterator():
        print(r["value"])
