"""Tables in the folder that all executors share: what an iterative or multi-pass operator reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from maskquery.session import shared_dir


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that a lost executor costs no replay.

    The folder is named after the operator with a fresh suffix and lives as long as the shared folder does.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that no column of the caller has (names differ by more than case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted
