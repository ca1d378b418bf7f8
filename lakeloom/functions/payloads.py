"""Compressed payloads and JSON values as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T


def inflate_checked(data: bytes | None, size: int | None, digest: str | None) -> bytes | None:
    """The whole body, or None unless it inflates wholly and agrees with size and digest."""
    if data is None or size is None or pd.isna(size) or digest is None:
        return None
    try:
        z = zlib.decompressobj()
        body = z.decompress(data, int(size) + 1)  # never more than one byte beyond what is declared
        if not z.eof and not z.unconsumed_tail:
            body += z.flush()
    except zlib.error:
        return None
    if not z.eof or len(body) != size or hashlib.sha256(body).hexdigest() != digest.lower():
        return None
    return body


def body_text(body: bytes | None) -> str | None:
    """UTF-8 text without a leading byte-order mark; None if it isn't text."""
    if body is None:
        return None
    try:
        return body.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(T.BooleanType())
def is_readable(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether a zlib body inflates wholly and agrees with its declared size and sha256."""
    for data, size, digest in batches:
        yield pd.Series([inflate_checked(*x) is not None for x in zip(data, size, digest)], dtype=bool)


def _canonical(v: object, skip: frozenset[str] = frozenset()) -> object:
    if isinstance(v, dict):
        return {k: _canonical(x) for k, x in v.items() if x is not None and k not in skip}
    if isinstance(v, list):
        return [_canonical(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def canonical_text(s: str | None, skip: frozenset[str] = frozenset()) -> str | None:
    """One spelling for all texts of the same JSON value.

    Key order, spacing, escapes and members that are null don't matter, nor do the top-level
    members in skip; 1 equals 1.0; array order matters. Text that isn't JSON stays as it is,
    behind a mark that no JSON text begins with.
    """
    if s is None:
        return None
    try:
        v = json.loads(s.removeprefix("﻿"))
    except (ValueError, RecursionError):
        return "\x00" + s
    return json.dumps(_canonical(v, skip), sort_keys=True, separators=(",", ":"))


def canonical_json(col: str, skip: tuple[str, ...] = ()):
    """Column of canonical_text."""
    out = frozenset(skip)

    @F.pandas_udf(T.StringType())
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([canonical_text(x, out) for x in s], dtype=object)

    return canonical(F.col(col))
