"""Session defaults, the shared folder, and ways to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC days, AQE, Arrow."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests on one machine) a temporary folder
    is set instead; on a cluster the setting is required, as no machine's own folder will do.
    """
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
        now = sc.getCheckpointDir()
    return now


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checked(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A materialised table, marked for broadcasting only if its rows take at most so many bytes.

    Rows are counted, and measured by their columns' widths, strings and arrays by their own
    size. Beyond the bound it stays a table that joins shuffle.
    """
    df = cut(df)
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c, kind in df.dtypes if kind.startswith(("string", "binary", "array", "map", "struct"))]
    size = F.sum(sum(wide, F.lit(16 * len(df.columns)))) if wide else F.count("*") * 16 * len(df.columns)
    return F.broadcast(df) if (df.agg(size.alias("b")).first()["b"] or 0) <= most_bytes else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, by a hash of a key, if it has fewer partitions than there are cores.

    For heavy work on small inputs, which come as a file or two; larger inputs stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """Parquet tables under the shared folder, for one query.

    ``put`` writes a DataFrame and reads it back (columnar, compressed: less disk than a
    checkpoint). ``drop`` deletes one table, and everything still there goes when the
    application ends, as lazily evaluated results may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._forget, self.root)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name))

    def write(self, df: DataFrame, name: str = "t") -> str:
        self._n += 1
        path = f"{self.root}/{name}{self._n}"
        df.write.mode("overwrite").parquet(path)
        return path

    def drop(self, path: str) -> None:
        self._forget(path)

    def _forget(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder is the cluster's to clean then
            pass
