"""Jobs over frozen inputs, their published results, and what results may be used again.

A job reads an input that was sealed (content fingerprint, see sources.files), runs a registered operator,
checks the whole output, and publishes it under its key; a key that is published already is returned as it
is. Everything lies in folders of any Hadoop file system; a folder without a manifest was never published."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.operators.rows import Registry
from lakeloom.plans.spec import QuerySpec
from lakeloom.sources import files


class Changed(RuntimeError):
    """A source that isn't at the commit it was expected at."""


def watermark(stores: dict[str, int]) -> int:
    """The commit that all stores of a source are at; Changed if they differ."""
    if len(set(stores.values())) != 1:
        raise Changed(f"stores at {sorted(stores.items())}")
    return next(iter(stores.values()))


def job_key(operator: str, version: int, params: dict, fingerprint: str) -> str:
    """The same for the same operator, parameters in any order, and content of the input."""
    plain = json.dumps([operator, version, params, fingerprint], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(plain.encode()).hexdigest()


def _published(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_job(rows: DataFrame, registry: Registry, operator: str, version: int, params: dict, folder: str, check: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """The published output of an operator over rows. The input is frozen first; the output is computed from
    the frozen input, written, checked by check(frozen, output) and by computing its fingerprint again, and
    only then has a manifest. A job that broke off is started again from the frozen input."""
    spark = rows.sparkSession
    found = files.row_fingerprint(rows, rows.columns).first()
    key = job_key(operator, version, params, found["fingerprint"])
    at = f"{folder}/{key}"
    if _published(spark, f"{at}/output"):
        return files.open_sealed(spark, f"{at}/output")
    files.seal(rows, f"{at}/input", rows.columns)
    frozen = files.open_sealed(spark, f"{at}/input")
    out = registry.apply(frozen, operator, version, params)
    if check is not None:
        check(frozen, out)
    files.seal(out, f"{at}/output", out.columns)
    return files.open_sealed(spark, f"{at}/output")


def reused(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frozen input by the key of what it was projected from: made once, opened again by every later job."""
    if not _published(spark, f"{folder}/{key}"):
        rows = make()
        files.seal(rows, f"{folder}/{key}", rows.columns)
    return files.open_sealed(spark, f"{folder}/{key}")


def within(spark: SparkSession, seconds: float, group: str, run: Callable[[], object]) -> object:
    """run() with a deadline: its jobs are cancelled when the time is over, which it sees as an error."""
    sc = spark.sparkContext
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, group, True)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


# --- reuse -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tier:
    """Where the result of a query is kept and for how many seconds; None for as long as its lake."""

    folder: str
    seconds: int | None


def tier(spec: QuerySpec) -> Tier:
    """Queries for ratings only are asked again and again and kept; all others for a day."""
    return Tier("lasting", None) if spec.conditions and all(c.field == "post.rating" for c in spec.conditions) else Tier("passing", 86_400)


def needs_fence(spec: QuerySpec) -> bool:
    """Whether a query depends on the state of a source; one over frozen scopes only doesn't."""
    return not spec.conditions or any(not c.field.startswith("project.") for c in spec.conditions)


def write_rating_bases(observations: DataFrame, folder: str) -> None:
    """The candidates of each rating in a folder of its own, so that a query for a rating reads only it."""
    observations.select("row_id", "post_id", "tag_string", F.coalesce("rating", F.lit("unknown")).alias("rating")).write.mode("overwrite").partitionBy("rating").parquet(folder)


def rating_base(spark: SparkSession, folder: str, ratings: list[str]) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("rating").isin(ratings))


def recipe(ranking: DataFrame, ratings: list[str] | None = None, routes: list[str] | None = None, best: int | None = None, rank: str = "main_rank", missing: Column | None = None) -> DataFrame:
    """The members of a fixed recipe over an immutable ranking, as a view that is never copied."""
    x = ranking
    for c, values in (("rating", ratings), ("route", routes)):
        x = x if values is None else x.where(F.col(c).isin(values))
    x = x if missing is None else x.where(missing)
    return x if best is None else x.where(F.col(rank) <= best)


def publish_view(ranking: DataFrame, name: str, **filters) -> str:
    """The members of a recipe as a relation for SQL."""
    recipe(ranking, **filters).createOrReplaceTempView(name)
    return name


def scalar_input(rows: DataFrame, kind: str, artifact: DataFrame | None = None) -> DataFrame:
    """rows with status and value of an operator's scalar input: stored bytes (length), the origin's width
    (width), or another artifact's column (ordinal, status, value)."""
    if kind == "artifact":
        a = artifact.select(F.col("ordinal").alias("__o"), F.col("status").alias("__s"), F.col("value").alias("__v"))
        return rows.join(a, F.col("ordinal") == F.col("__o"), "left").withColumns({"status": F.coalesce("__s", F.lit("missing")), "value": F.col("__v")}).drop("__o", "__s", "__v")
    c = F.col({"bytes": "length", "width": "width"}[kind])
    return rows.withColumns({"value": c, "status": F.when(c.isNull(), "missing").otherwise("available")})


def with_input(result: DataFrame, frozen: DataFrame) -> DataFrame:
    """A result beside the frozen input it came from, by ordinal."""
    own = [c for c in frozen.columns if c not in result.columns]
    return result.join(frozen.select(F.col("ordinal").alias("__o"), *own), F.col("ordinal") == F.col("__o")).drop("__o")


def write_ranking(ranking: DataFrame, folder: str, rank: str = "main_rank") -> None:
    """A ranking table by rating, in rank order within each file, so that pages and ranks prune files."""
    ranking.repartitionByRange(F.col("rating"), F.col(rank)).sortWithinPartitions("rating", rank).write.mode("overwrite").partitionBy("rating").parquet(folder)


def arrow_page(rows: DataFrame, most: int, about: dict[str, str]) -> tuple[bytes, str]:
    """(Arrow IPC bytes, their sha256) of a page of at most most rows, with what it is in the schema."""
    import pyarrow as pa

    table = rows.limit(most + 1).toArrow()
    if len(table) > most:
        raise ValueError(f"more than {most} rows")
    table = table.replace_schema_metadata(about)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    data = sink.getvalue().to_pybytes()
    return data, hashlib.sha256(data).hexdigest()
