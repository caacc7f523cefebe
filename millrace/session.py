"""Sessions and table access shared by the queries, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


#: Rows of an Arrow batch: texts are long, and a batch stands in both processes and in direct memory.
ARROW_ROWS = 2_000
#: Bytes of one, for rows that are longer still.
ARROW_BYTES = 8 << 20
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(ARROW_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{ARROW_BYTES}b")}


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once an application; Spark hands the archive out. Arrow batches get ARROW_ROWS rows and
    ARROW_BYTES bytes at most, unless the session has numbers of its own."""
    context = spark.sparkContext
    for name, (default, ours) in _ARROW.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, ours)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace.zip"
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(held))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    # What was shuffled on the way is not needed once the table stands.
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to run reads them."""
    for made in tables:
        path = getattr(made, "_scratch_path", None)
        if path:
            jvm = made.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
