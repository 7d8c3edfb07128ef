"""Sessions for local work, and the folder checkpoints go to."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g", app: str = "leafspan") -> SparkSession:
    """A local[cpus] session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions or cpus)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once per application, so that they find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="leafspan-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/leafspan.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/leafspan.zip")
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir of the session, which all executors share. Where none is set, a session that runs on this
    machine alone has a temporary one; on a cluster that would lose data, so it is refused."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="leafspan-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


_local: list[str] = []
_tables: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table to the shared folder and read back, so that it is computed once, is read by column, and
    outlives lost executors. This runs a job while the plan is built. The table goes with the application, or with ``clear`` before."""
    path = f"{shared_folder(df.sparkSession)}/leafspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _place(df.sparkSession, path)
    files.deleteOnExit(where)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many partitions as the session's shuffles have. For stages with much work on few bytes: adaptive
    coalescing sees only the bytes and would put them into a task or two. The keys must be of bounded groups, as pages are. They are taken
    in reverse, lest Spark leaves the shuffle out where the rows stand by the same keys, but coalesced, already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *reversed(keys))


def _place(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far and gives their number. To be called when the results that came from them are written."""
    n = len(_tables)
    while _tables:
        where, files = _place(spark, _tables.pop())
        files.delete(where, True)
    return n
