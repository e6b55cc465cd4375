"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Set while a table is written: shuffle files go with their step, and buckets of one file count as sorted.
SETTINGS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.legacy.bucketedTableScan.outputOrdering")
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
_own: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a temporary folder for a local session, as in tests, and an error on a cluster."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="foliomill-")
    return _own


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches take ``BATCH_BYTES`` at most, or less if it says so; a longer row stands alone.

    An operator holds a batch several times over (in the JVM, as texts, as results), in each task of an executor.
    The setting stays, as results are evaluated later.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def carried(names: tuple[str, ...]) -> list[Column]:
    """The columns of these names as one struct, so that they can't clash with an operator's own; none for no names."""
    return [F.struct(*[F.col(f"`{n}`") for n in names]).alias("carried")] if names else []


def struct(fields: list[tuple]) -> StructType:
    """A schema of (name, type)."""
    out = StructType()
    for name, kind in fields:
        out.add(name, kind)
    return out


class Workspace:
    """Named Parquet tables of one operator call.

    A written table cuts the lineage: a lost executor costs only the tasks of the step that runs,
    and a nondeterministic plan isn't evaluated twice. Shuffle files of a finished step are dropped
    at once, so that disk holds the largest step and not the sum of all.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def tables(self) -> dict[str, bool]:
        """Names of the tables, and whether each is whole."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return {n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")) for n in names}

    @contextlib.contextmanager
    def _set(self) -> Iterator[None]:
        kept = {k: self.spark.conf.get(k, "false") for k in SETTINGS}
        for k in SETTINGS:
            self.spark.conf.set(k, "true")
        try:
            yield
        finally:
            for k, v in kept.items():
                self.spark.conf.set(k, v)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table as read back."""
        with self._set():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def write_buckets(self, df: DataFrame, name: str, n: int, by: list[str]) -> DataFrame:
        """Write df in n buckets sorted by the columns they are made of, so that joins and groups by these columns shuffle nothing."""
        with self._set():
            df.write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        return self.spark.table(self._table(name))

    def open_buckets(self, name: str, schema: str, n: int, by: list[str]) -> DataFrame:
        """The table that write_buckets made, perhaps in another session."""
        keys = ", ".join(by)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self._table(name))

    def _table(self, name: str) -> str:
        return f"spark_catalog.default.t{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{name}"

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
