"""Training logs as streams: noise removal and metric extraction with a running epoch per run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskquery.functions.scalars import is_noise, metric_values
from maskquery.session import shared_dir


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Log files appearing under ``path`` as a stream of ``(run, line)``; the run is the file's folder."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value").alias("line"))


def drop_noise(lines: DataFrame) -> DataFrame:
    """Stateless filter, the same expression as in batch."""
    return lines.where(~is_noise(F.col("line")))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Process all that is available into a table in the shared folder and read it back."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession)
    q = (
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


METRICS = ("accuracy", "loss", "val_accuracy", "val_loss")
_ROW = "run string, epoch int, " + ", ".join(f"{n} double" for n in METRICS)


class _Epochs(StatefulProcessor):
    """Numbers a run's metric lines on from the count that the state store keeps for the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        seen = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((seen + len(batch),))
        out = pd.DataFrame({"run": key[0], "epoch": (seen + 1 + np.arange(len(batch))).astype(np.int32)})
        for n in METRICS:
            out[n] = batch[n].to_numpy()
        yield out

    def close(self) -> None:
        pass


def training_metrics(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Metric lines of a stream ``(run, line_no, line)`` with the running epoch of each run, all that is available now.

    The count of a run is keyed state in the state store, so a query that is started again on the same ``folder`` numbers on
    where it stopped, and a batch that is replayed after a failure gives the same rows. A batch must hold a run's lines in
    full if they are to be in order; those of one run and batch are sorted in one task, so let the source limit the size of
    batches.
    """
    spark, out = stream.sparkSession, folder or _folder(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hits = stream.select("run", "line_no", metric_values(F.col("line")).alias("m")).where("m IS NOT NULL")
    rows = hits.select("run", "line_no", *[F.col("m")[i].alias(n) for i, n in enumerate(METRICS)])
    numbered = rows.groupBy("run").transformWithStateInPandas(_Epochs(), outputStructType=_ROW, outputMode="Append", timeMode="None")
    q = (
        numbered.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(_ROW).parquet(f"{out}/data")
