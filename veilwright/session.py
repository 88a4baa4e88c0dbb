"""Session settings and the shared scratch folder.

Intermediate tables that must not change between two reads (ranked rows, for
instance) are written to the folder the cluster names in
``spark.checkpoint.dir``; they survive the loss of any executor, unlike cached
blocks.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "veilwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the workers, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "veilwright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else the code came in an archive already
        archive = shutil.make_archive(tempfile.mkdtemp(prefix="code-") + "/" + package.name, "zip", package.parent, package.name)
        context.addPyFile(archive)
    context.veilwright_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` when set. Only a local session may fall back to a
    fresh temporary folder: on a cluster that folder would exist on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fresh = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/veilwright-{label}-{uuid.uuid4().hex}"


@dataclass
class ScratchOwner:
    """The folders that a run has staged; ``release`` deletes them."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_owners: ContextVar[tuple[ScratchOwner, ...]] = ContextVar("owners", default=())


@contextmanager
def owned_scratch(spark: SparkSession, keep: bool = False) -> Iterator[ScratchOwner]:
    """What is staged inside belongs to one owner and is deleted at the end, or with ``keep`` when it is released.

    Tables that read from it are of no use afterwards. A failed run is cleaned up, too.
    """
    owner = ScratchOwner(spark)
    token = _owners.set((*_owners.get(), owner))
    try:
        yield owner
    except BaseException:
        owner.release()
        raise
    finally:
        _owners.reset(token)
    if not keep:
        owner.release()


def stage(df: DataFrame, label: str, owner: ScratchOwner | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. It belongs to ``owner`` or the innermost run."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for own in [owner] if owner else _owners.get()[-1:]:
        own.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
