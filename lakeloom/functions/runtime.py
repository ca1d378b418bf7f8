"""Session-level helpers: durable cuts of the lineage and global numbering."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_own_dirs: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, one machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_dirs.get(sc.applicationId)
        if named is None:
            named = _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="lakeloom-cut-")
            atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: By application, of each folder of stored(): a weak reference to its plans' index of the files, and the path.
_stored: dict[str, list[tuple]] = {}
#: Bytes stored since plans and files that nothing refers to were last cleared, and after how many they are.
_since, CLEAR_AFTER = [0], 64_000_000


def stored(df: DataFrame) -> DataFrame:
    """cut, but as compressed columns: for wide rows, of which later steps read some columns only. Order and
    partitions of the rows aren't kept. A folder is deleted once no plan refers to it any more (an RDD taken
    from a DataFrame isn't a plan: keep the DataFrame as well)."""
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any(t == "void" for _, t in df.dtypes):
        return cut(df)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _stored.setdefault(spark.sparkContext.applicationId, []).append((spark._jvm.java.lang.ref.WeakReference(files), path))
    _since[0] += files.sizeInBytes()
    del files
    if _since[0] > CLEAR_AFTER:
        _since[0] = 0
        clear_stored(spark)
    return out


def clear_stored(spark: SparkSession) -> None:
    """Delete the folders of stored() that no plan refers to; shuffle files go with their plans."""
    gc.collect()
    spark._jvm.System.gc()
    kept, app = [], spark.sparkContext.applicationId
    for ref, path in _stored.pop(app, []):
        if ref.get() is None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        else:
            kept.append((ref, path))
    _stored[app] = kept


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the checkpoint folder, once its results are stored or
    no longer wanted: a DataFrame that was cut can't be read after that."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(named.get())
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(path):
            fs.delete(f.getPath(), True)


def global_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number all rows 0..n-1 in the given total order without a single-task window.

    A range shuffle sorts the rows (ties split over tasks as long as the order names a
    unique key), the sorted rows are written once so that the numbering can't change when a
    lost task runs again, and only one row count per partition is summed up.
    """
    part, local = "__part", "__local"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(
        sorted_.withColumn("__id", F.monotonically_increasing_id())
        .withColumn(part, F.shiftright("__id", 33).cast("int"))
        .withColumn(local, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id")
    )
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # one row per partition
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop(part, local)
    offsets = F.array(*[F.lit(x).cast("long") for x in starts]) if len(starts) <= 64 else None
    if offsets is None:
        table = df.sparkSession.createDataFrame(list(enumerate(starts)), T.StructType([T.StructField(part, T.IntegerType()), T.StructField("__start", T.LongType())]))
        return placed.join(F.broadcast(table), part).withColumn(name, F.col("__start") + F.col(local)).drop(part, local, "__start")
    return placed.withColumn(name, F.element_at(offsets, F.col(part) + 1) + F.col(local)).drop(part, local)


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, as one zip."""
    sc = spark.sparkContext
    if _shipped.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lakeloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/{root.name}.zip")
    _shipped["app"] = sc.applicationId


_shipped: dict[str, str] = {}


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least one partition a core, for work that costs far more than reading its rows:
    a few small files would otherwise be a few tasks. Scans of more partitions stay as they are."""
    sc = scan.sparkSession.sparkContext
    few = scan._jdf.queryExecution().toRdd().getNumPartitions() < sc.defaultParallelism
    return scan.repartition(sc.defaultParallelism) if few else scan
