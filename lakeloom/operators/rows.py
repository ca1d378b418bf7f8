"""Row operators and their registry: manifest, scalar with four states, export names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Operator:
    """A named, versioned function of a frozen input; normalise checks and completes parameters."""

    id: str
    version: int
    required: tuple[str, ...]
    normalise: Callable[[dict], dict]
    run: Callable[[DataFrame, dict], DataFrame]


class Registry:
    """Operators by id and version; each pair once."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, int], Operator] = {}

    def add(self, op: Operator) -> Operator:
        if (op.id, op.version) in self._held:
            raise ValueError(f"{op.id} {op.version} is registered")
        self._held[op.id, op.version] = op
        return op

    def apply(self, rows: DataFrame, op: str, version: int, params: dict) -> DataFrame:
        found = self._held.get((op, version))
        if found is None:
            raise KeyError(f"{op} {version}")
        missing = set(found.required) - set(rows.columns)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
        return found.run(rows, found.normalise(params))


def scalar(value: Column, multiply: int, add: int) -> Column:
    """(status, value, code): value * multiply + add; a missing value stays missing, an overflow fails."""
    out = F.try_add(F.try_multiply(value, F.lit(multiply).cast("long")), F.lit(add).cast("long"))
    status = F.when(value.isNull(), "missing").when(out.isNull(), "failed").otherwise("available")
    return F.struct(status.alias("status"), out.alias("value"), F.when(value.isNotNull() & out.isNull(), "INTEGER_OVERFLOW").alias("code"))


def export_name(ordinal: Column, stem: Column, extension: Column, limit: int = 80) -> Column:
    """000001_stem.ext: what a file system may not take becomes _, and the stem is cut to limit."""
    clean = F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.substring(clean, 1, limit), r"[ .]+$", "")
    return F.concat(F.lpad(ordinal.cast("string"), 6, "0"), F.lit("_"), F.when(clean == "", "item").otherwise(clean), F.lit("."), F.coalesce(extension, F.lit("bin")))


def sidecar(tags: Column, style: str) -> Column:
    """The text beside an exported file: tags with spaces for underscores, joined by commas."""
    words = F.filter(F.split(tags, " "), lambda t: t != "")
    shown = F.transform(words, lambda t: F.replace(t, F.lit("_"), F.lit(" "))) if style == "spaces" else words
    return F.array_join(shown, ", ")


def _manifest(rows: DataFrame, params: dict) -> DataFrame:
    return rows.select("ordinal", "asset_id", F.to_json(F.struct(*params["fields"])).alias("record"))


def _manifest_params(params: dict) -> dict:
    fields = sorted(set(params.get("fields", [])))
    if not 1 <= len(fields) <= 8:
        raise ValueError("1 to 8 fields")
    return {"fields": fields}


def default_registry() -> Registry:
    r = Registry()
    r.add(Operator("manifest", 1, ("ordinal", "asset_id"), _manifest_params, _manifest))
    r.add(Operator("scalar", 1, ("ordinal", "value"), lambda p: {"multiply": int(p.get("multiply", 1)), "add": int(p.get("add", 0))}, lambda rows, p: rows.select("ordinal", scalar(F.col("value"), p["multiply"], p["add"]).alias("r")).select("ordinal", "r.*")))
    r.add(Operator("export_names", 1, ("ordinal", "stem", "extension"), lambda p: {"limit": int(p.get("limit", 80))}, lambda rows, p: rows.select("ordinal", export_name(F.col("ordinal"), F.col("stem"), F.col("extension"), p["limit"]).alias("file_name"))))
    return r
