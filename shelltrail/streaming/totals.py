"""Running totals of what streams observe, as a table that outlives the query's own memory."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shelltrail.session import Folder

SCHEMA = "metric string, total long, batches long"


class MetricTotals(StreamingQueryListener):
    """Adds up the whole numbers that queries observe (``stream_metrics``, ``observe_ingest``), per query and metric.

    After every micro-batch one folder ``query=<id>/batch=<n>`` under ``path`` gets the totals so far, a row per metric, and
    the folder before the last one goes. A query keeps its id over restarts from its checkpoint, and goes on from the newest
    folder below its batch, so a batch that is run and reported again counts once. A batch that was committed but whose
    report was lost with the driver is missing from the totals: counts that must not miss it belong into the sink.

        totals = MetricTotals(spark, "/metrics"); spark.streams.addListener(totals)
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.seen: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = {
            f"{name}.{metric}": value
            for name, row in progress.observedMetrics.items()
            for metric, value in row.asDict().items()
            if isinstance(value, int) and not isinstance(value, bool)
        }
        if observed:
            self.add(str(progress.id), progress.batchId, observed)
        self.seen[str(progress.id)] = progress.batchId

    def add(self, query: str, batch: int, observed: dict[str, int]) -> None:
        folder = f"{self.path}/query={query}"
        older = [number for number in _batches(self.spark, folder) if number < batch]
        totals = {}
        if older:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{folder}/batch={older[-1]}").collect()
            totals = {row["metric"]: (row["total"], row["batches"]) for row in rows}
        for metric, value in observed.items():
            total, batches = totals.get(metric, (0, 0))
            totals[metric] = (total + value, batches + 1)
        rows = self.spark.createDataFrame([(metric, *counted) for metric, counted in sorted(totals.items())], SCHEMA)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        for number in older[:-1]:
            Folder(self.spark, f"{folder}/batch={number}").delete()

    def catch_up(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Waits until the last batch of a query that has ended is in the totals; reports come a little after it."""
        last = max((report["batchId"] for report in query.recentProgress if report["numInputRows"]), default=-1)
        end = time.monotonic() + seconds
        while self.seen.get(str(query.id), -1) < last:
            if time.monotonic() > end:
                raise TimeoutError(f"no report of batch {last}")
            time.sleep(0.05)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Complete totals, oldest first."""
    numbers = [int(name.partition("=")[2]) for name in Folder(spark, folder).names() if name.startswith("batch=")]
    return sorted(number for number in numbers if Folder(spark, f"{folder}/batch={number}").has("_SUCCESS"))


def metric_totals(spark: SparkSession, path: str) -> DataFrame:
    """query, metric, total, batches: the newest totals of every query under ``path``. At most two folders a query are read."""
    rows = spark.read.schema(f"{SCHEMA}, query string, batch long").option("basePath", path).parquet(path)
    newest = F.max("batch").over(Window.partitionBy("query"))
    return rows.withColumn("_newest", newest).where("batch = _newest").select("query", "metric", "total", "batches")
