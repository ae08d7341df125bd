"""Session construction and the few execution helpers shared by all operators.

Everything here is plain Spark: a session builder with AQE on, a checked
broadcast, and lineage cutting through ``checkpoint()`` in the folder the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be broadcast: rows, and bytes (counted rows x a row's size).
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def build_session(master: str | None = None, app_name: str = "basketcast",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session for local runs, tests and the benchmark (UI off, AQE on, UTC)."""
    master = master or os.environ.get("BASKETCAST_MASTER", "local[8]")
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", os.environ.get("BASKETCAST_DRIVER_MEMORY", "8g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Point the context at ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder and is only read here.
    Only a local session without the setting (tests, laptops) gets a folder of
    its own under the system temp directory. A session without a classic
    SparkContext (Spark Connect) keeps whatever its server is configured with.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset runtime conf raises
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="basketcast-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # this process's own folder
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back.

    Ends the lineage like :func:`cut_lineage`, and the planner knows its real size: a checkpointed frame keeps
    the estimate of the plan it came from, which joins multiply, so in loops of joins those estimates
    grow to numbers of millions of digits. For frames with named, distinct, typed columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, int, DataFrame]:
    """Checkpoint ``df`` and count it once: ``(table, rows, join side)``.

    The join side is the same table marked for broadcast when its counted size is
    within the bound, else left to a shuffle join.
    """
    table = cut_lineage(df)
    rows, size = _measure(table)
    small = rows <= max_broadcast_rows and size <= DEFAULT_BROADCAST_BYTES
    return table, rows, F.broadcast(table) if small else table


def _measure(df: DataFrame) -> tuple[int, int]:
    """Rows and the bytes they hold, in one job: strings, binaries and arrays by their real
    length, other values as 8 bytes."""
    per_row = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width = F.octet_length(c)
        elif kind in ("array", "map", "struct"):
            width = F.octet_length(F.to_json(c)) if kind != "map" else F.size(c) * 64
        else:
            width = F.lit(8)
        per_row = per_row + F.coalesce(width.cast("long"), F.lit(8).cast("long"))
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(per_row), F.lit(0))).first()
    return int(row[0]), int(row[1])


def keep(df: DataFrame) -> DataFrame:
    """Persist a result that several later stages read (spills, recomputes on loss)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after measuring it (written once, so it is not computed twice);
    beyond the bounds leave the join to a shuffle."""
    return materialize(df, max_rows)[2]


def scalar(df: DataFrame, default=None):
    """First column of the first row of a one-row aggregate."""
    row = df.first()
    if row is None or row[0] is None:
        return default
    return row[0]
