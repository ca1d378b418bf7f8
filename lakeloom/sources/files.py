"""Sources and sinks: packed byte ranges, JSON pages, embedded resources, sealed datasets, exports."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet facts with a fixed schema: nothing is inferred, absent columns are null."""
    return spark.read.schema(schema).parquet(path)


def generated(spark: SparkSession, n: int = 32) -> DataFrame:
    """n synthetic objects with the hash of their number."""
    return spark.range(1, n + 1).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") * 100).alias("length"), F.lit("webp").alias("stored_ext"))


def file_system(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI (or absolute path) and the path in it: tasks read and write where all
    executors see the same files, not on a disk of their own."""
    return pa.fs.FileSystem.from_uri(root)


def packed_ranges(rows: DataFrame, root: str, key: str) -> DataFrame:
    """(key, data, ok) of rows (key, pack_path, offset, length, sha256): the bytes of each range, read in
    the order of the packs, and whether they have the hash. A missing file or short range is not ok."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(root)
        opened: tuple[str, pa.NativeFile] | None = None
        for b in batches:
            out = []
            for k, path, offset, length, sha in zip(b[key], b["pack_path"], b["offset"], b["length"], b["sha256"]):
                data = None
                try:
                    if opened is None or opened[0] != path:
                        opened = (path, fs.open_input_file(f"{base}/{path}"))
                    data = opened[1].read_at(int(length), int(offset))
                except (OSError, TypeError, ValueError):
                    opened = None
                ok = data is not None and len(data) == length and hashlib.sha256(data).hexdigest() == sha
                out.append((k, data, ok))
            yield pd.DataFrame(out, columns=[key, "data", "ok"])

    kind = dict(rows.dtypes)[key]
    wanted = rows.select(key, "pack_path", "offset", "length", "sha256").repartitionByRange("pack_path", "offset").sortWithinPartitions("pack_path", "offset")
    return wanted.mapInPandas(read, f"`{key}` {kind}, data binary, ok boolean")


def container_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows whose logical file (path) lies in a container, with the container's path and shifted offset."""
    m = members.select(F.col("path").alias("__p"), "container", F.col("start").alias("__start"))
    joined = rows.join(m, F.col("pack_path") == F.col("__p"), "left")
    return joined.withColumn("offset", F.col("offset") + F.coalesce("__start", F.lit(0))).withColumn("pack_path", F.coalesce("container", "pack_path")).drop("__p", "__start", "container")


def json_page(rows: DataFrame, key: str, text: str, path: str = "$") -> DataFrame:
    """(key, position, record): the objects of a JSON page's array, each as its own text."""
    inner = F.col(text) if path == "$" else F.get_json_object(text, path)
    parts = F.from_json(inner, "array<string>")
    return rows.select(key, F.posexplode(parts).alias("position", "record"))


class _Scripts(HTMLParser):
    def __init__(self, wanted: str) -> None:
        super().__init__()
        self.wanted, self.inside, self.found = wanted, False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside = tag == "script" and (dict(attrs).get("type") or "") == self.wanted
        if self.inside:
            self.found.append("")

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "script"

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1] += data


def embedded_json(html: str | None, kind: str = "application/json") -> list[str]:
    """The JSON texts in a page's scripts of the type; those that don't parse are left out."""
    p = _Scripts(kind)
    p.feed(html or "")
    out = []
    for s in p.found:
        try:
            json.loads(s)
            out.append(s.strip())
        except ValueError:
            continue
    return out


def embedded_resources(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, resource) of every JSON text embedded in a page."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scripts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(embedded_json)

    return rows.select(key, F.explode(scripts(F.col(html))).alias("resource"))


def row_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, fingerprint): the same for any order and partitioning of the rows, other for any other
    content: sums of two hashes of each row, exact and without a sort."""
    one = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    two = F.xxhash64(F.lit("second"), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", total(one).cast("string"), total(two).cast("string"), F.count("*").cast("string")), 256).alias("fingerprint"))


def seal(rows: DataFrame, folder: str, columns: list[str], partition: str | None = None, sort: list[str] | None = None) -> dict:
    """Write rows as a sealed dataset: data first, then a manifest with count and fingerprint; a folder
    without its manifest was never sealed. An existing manifest of the same content is kept (a replay
    does nothing), one of other content is an error."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = row_fingerprint(rows, columns).first()
    manifest = {"rows": found["rows"], "fingerprint": found["fingerprint"], "columns": columns, "schema": rows.select(*columns).schema.json()}
    if fs.exists(path):
        held = read_manifest(spark, folder)
        if held != manifest:
            raise ValueError("another dataset is sealed here")
        return held
    out = (rows.sortWithinPartitions(*sort) if sort else rows).select(*columns).write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(f"{folder}/data")
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json.new")
    stream = fs.create(staged, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    if not fs.rename(staged, path):
        raise OSError("the manifest couldn't be put in place")
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def open_sealed(spark: SparkSession, folder: str) -> DataFrame:
    """A sealed dataset, after its count and fingerprint have been checked."""
    m = read_manifest(spark, folder)
    schema = T.StructType.fromJson(json.loads(m["schema"]))  # partition columns have no type of their own on disk
    rows = spark.read.schema(schema).parquet(f"{folder}/data").select(*m["columns"])
    found = row_fingerprint(rows, m["columns"]).first()
    if (found["rows"], found["fingerprint"]) != (m["rows"], m["fingerprint"]):
        raise ValueError("the dataset isn't what was sealed")
    return rows


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """One JSON object per row, nulls included."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def compact(spark: SparkSession, source: str, target: str, bytes_per_file: int = 256 << 20) -> int:
    """Rewrite many small files as few: the number of files follows from their size, without a shuffle."""
    src = spark._jvm.org.apache.hadoop.fs.Path(source)
    size = src.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(src).getLength()
    files = max(1, -(-size // bytes_per_file))
    spark.read.parquet(source).coalesce(int(files)).write.mode("overwrite").parquet(target)
    return int(files)


def write_exports(rows: DataFrame, folder: str) -> DataFrame:
    """Write (file_name, data, sidecar) as files with their text beside them, within the tasks; the
    result tells (file_name, bytes). Names that leave the folder are refused."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            out = []
            for name, data, side in zip(b["file_name"], b["data"], b["sidecar"]):
                if not re.fullmatch(r"[^/\\\0]+", name) or name in (".", ".."):
                    raise ValueError(f"file name {name!r}")
                for path, content in ((f"{base}/{name}", data), (f"{base}/{name}.txt", side.encode() if side is not None else None)):
                    if content is not None:
                        with fs.open_output_stream(path + ".part") as f:
                            f.write(content)
                        fs.move(path + ".part", path)
                out.append((name, len(data)))
            yield pd.DataFrame(out, columns=["file_name", "bytes"])

    return rows.select("file_name", "data", "sidecar").mapInPandas(write, "file_name string, bytes long")
