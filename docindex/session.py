"""What a session needs: the package where its tasks run, and tables that outlive
executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_attached: set[str] = set()
#: Folders made for local applications that name none.
_local: dict[str, str] = {}


def attach(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that
    their Python workers can import it without it being installed there."""
    context = spark.sparkContext
    if context.applicationId in _attached:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docindex-")) / "docindex.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    _attached.add(context.applicationId)


def attach_active() -> None:
    """The same for the running session, where only columns are at hand."""
    session = SparkSession.getActiveSession()
    if session is not None:
        attach(session)


def load_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir``
    names it. Only where that is unset (local tests) a temporary folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="docindex-")
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later
    steps read files that survive the loss of executors, and lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is made within it loses its shuffle files as soon as it has been executed (Spark 4.1 and later), not when the driver's JVM happens to collect
    its garbage. For steps that are executed once, such as tables to materialize; what the caller gets to execute is made outside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can reach it; PySpark has no call of its own for that."""
    at, system = _system(spark, path)
    system.delete(at, True)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, by name; nothing if there is no such folder."""
    at, system = _system(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """The paths of the folders that lie in a folder."""
    at, system = _system(spark, folder)
    return [f.getPath().toString() for f in system.listStatus(at) if f.isDirectory()]


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file."""
    at, system = _system(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_file_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file that appears whole or not at all; False if there is one of that name already."""
    at, system = _system(spark, path)
    made, _ = _system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = system.create(made)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    rename = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(made, at, rename)  # fails where the target exists
        return True
    except Exception as e:
        system.delete(made, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read any more."""
    for df in tables:
        remove(df.sparkSession, df.written_to)
