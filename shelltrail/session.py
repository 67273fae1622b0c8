"""Session settings the results depend on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Results depend on these, so they are pinned on whatever session is handed in.
# The state store on local disk is the one that keeps lists per key.
PINNED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in PINNED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "shelltrail") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.metricsEnabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for one written table, below the folder the cluster shares.

    Tasks on other machines must see it, so a machine-local folder is only
    chosen for a local master, where nothing names one.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Folder:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [entry.getPath().getName() for entry in self.store.listStatus(self.path)] if self.store.exists(self.path) else []

    def has(self, name: str) -> bool:
        return self.store.exists(self.path.suffix(f"/{name}"))

    def delete(self) -> None:
        self.store.delete(self.path, True)
