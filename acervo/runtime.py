"""Session-level helpers shared by every operator: tables, checkpoints, size checks."""

from __future__ import annotations

import gc
import hashlib
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows and bytes stay under these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000

#: Spellings that stand for a missing value in any string column.
NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a")


#: Files of cut lineage are released at most this often.
RELEASE_SECONDS = 3.0
_released = 0.0
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the package's source to the Python workers of the session's application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    sources = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
    folder = Path(tempfile.mkdtemp(prefix="acervo-"))
    target = folder / f"acervo-{mark}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sources:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = str(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(column):
    """The column, or NULL where it holds blank text or a null token."""
    column = F.col(column) if isinstance(column, str) else column
    bare = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(~bare.isin(*NULL_TOKENS), column)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in one local process where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        present = sc._jsc.sc().getCheckpointDir()
        if present.isDefined():
            named = present.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            named = os.path.join(tempfile.gettempdir(), "acervo-checkpoints")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    global _released
    checkpoint_dir(df.sparkSession)
    if time.monotonic() - _released > RELEASE_SECONDS:
        # shuffle files that no lineage needs any more go when the driver collects its garbage; those of ``df``
        # itself are held until the caller drops it, so they go before the next cut makes its own; plans that
        # only cycles of Python's hold would keep theirs
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        _released = time.monotonic()
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors read, in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``shared_folder`` with its files."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _opened(file: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file named by a path or URI, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))


def write_file(file: str, content: bytes | memoryview) -> None:
    """Write a file whole: it has its name once all of it is there."""
    store, path = _opened(file)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)


def read_file(file: str) -> bytes:
    """All of a file."""
    store, path = _opened(file)
    with store.open_input_stream(path) as held:
        return held.read()


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows of ``most_bytes`` in all; reads no more than ``limit + 1`` rows."""
    plain = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}
    sizes = [F.lit(8) if kind in plain else F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(8)) for c, kind in df.dtypes]
    rows, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0))).first()
    return rows <= limit and held <= most_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its checked size allows one, unchanged otherwise."""
    return F.broadcast(df) if small_enough(df, limit) else df
