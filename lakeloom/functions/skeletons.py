"""The containers of a JSON text, level by level, as nested Arrow arrays.

A skeleton is an array of levels; a level is an array of containers (objects and arrays), each
with the position of its parent in the level above, its key or index there, whether it is an
object, whether all its keys are decimal digits, and its own scalar members if asked for. What a
container means is left to SQL. SQL's walk over the levels copies all paths at every level, so a text of
more than DEEP levels, which would take it very long, is walked here instead, by the same rules.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from lakeloom.functions.payloads import body_text, inflate_checked

NODE = T.StructType([
    T.StructField("up", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("obj", T.BooleanType()),
    T.StructField("digits", T.BooleanType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())),
])
#: A child object as the walk finds it.
CHILD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("digits", T.BooleanType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())),
])
SKELETON = T.StructType([T.StructField("levels", T.ArrayType(T.ArrayType(NODE))), T.StructField("deep", T.ArrayType(CHILD))])
#: Levels up to which SQL walks a text.
DEEP = 200


def _no_constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity aren't JSON


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def parse(text: str | None) -> object:
    """The value of a JSON text without its byte-order mark; None for anything else."""
    if text is None:
        return None
    try:
        return _decoder.decode(text.removeprefix("﻿"))
    except ValueError:
        return None
    except RecursionError:
        try:
            return parse_deep(text.removeprefix("﻿"))
        except ValueError:
            return None


_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?\d[\d.eE+-]*|true|false|null))', re.ASCII)


def parse_deep(text: str) -> object:
    """The value of a JSON text nested to any depth, with a stack of its own; ValueError for anything else."""
    stack: list[tuple[object, str | None]] = []  # open containers with the key that waits for a value
    at, end, done, out = 0, len(text.rstrip(" \t\r\n")), False, None
    want = "value"  # or key, first (a value, key or end of a new container), colon, next
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None or done:
            raise ValueError(at)
        mark, string, plain = m.groups()
        at = m.end()
        top = stack[-1][0] if stack else None
        if mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "next" and stack:
            want = "key" if type(top) is dict else "value"
        elif mark in ("}", "]") and stack and want in ("next", "first") and (type(top) is dict) == (mark == "}"):
            stack.pop()
            want, done = "next", not stack
        elif string is not None and (want == "key" or want == "first" and type(top) is dict):
            stack[-1] = (top, json.loads(string))
            want = "colon"
        elif (mark in ("{", "[") or string is not None or plain is not None) and (want == "value" or want == "first" and type(top) is list):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(string or plain)
            if top is None:
                out = value
            elif type(top) is dict:
                top[stack[-1][1]] = value
            else:
                top.append(value)
            if mark:
                stack.append((value, None))
                want = "first"
            else:
                want, done = "next", not stack
        else:
            raise ValueError(at)
    if not done:
        raise ValueError(end)
    return out


def _plain(x: object) -> str | None:
    return x if x is None or type(x) is str else json.dumps(x)


class _Columns:
    """Collects the skeletons of one batch as flat columns."""

    def __init__(self, values: bool, fields: tuple[str, ...]) -> None:
        self.fields, self.deep, self.deep_rows = frozenset(fields), [], [0]
        self.up, self.key, self.idx, self.obj, self.digits, self.values = [], [], [], [], [], [] if values else None
        self.levels, self.rows = [0], [0]

    def _put(self, up: int, key: str | None, idx: int | None, x: object) -> None:
        is_dict = type(x) is dict
        self.up.append(up)
        self.key.append(key)
        self.idx.append(idx)
        self.obj.append(is_dict)
        self.digits.append(is_dict and all(k.isascii() and k.isdigit() for k in x))
        if self.values is not None:
            self.values.append([(k, _plain(y)) for k, y in x.items() if type(y) is not dict and type(y) is not list] if is_dict else None)

    def add(self, v: object) -> None:
        nodes, levels = len(self.up), len(self.levels)
        level = [v] if type(v) in (dict, list) else []
        if level:
            self._put(-1, None, None, v)
        while level:
            self.levels.append(len(self.up))
            below = []
            for up, x in enumerate(level):
                if type(x) is dict:
                    for k, y in x.items():
                        kind = type(y)
                        if kind is str and k.endswith("_json"):
                            y = parse(y)  # a text holding an array or object stands for it
                            kind = type(y)
                        if kind is dict or kind is list:
                            self._put(up, k, None, y)
                            below.append(y)
                else:
                    for i, y in enumerate(x):
                        if type(y) is dict or type(y) is list:
                            self._put(up, None, i, y)
                            below.append(y)
            level = below
            if len(self.levels) - levels > DEEP:
                for column in (self.up, self.key, self.idx, self.obj, self.digits, self.values):
                    if column is not None:
                        del column[nodes:]
                del self.levels[levels:]
                self._walk(v)
                break
        self.rows.append(len(self.levels) - 1)
        self.deep_rows.append(len(self.deep))

    def _walk(self, v: object) -> None:
        """The child objects of a deep value, with a stack of its own."""
        digits = lambda x: type(x) is dict and all(k.isascii() and k.isdigit() for k in x)
        stack = [(v, "$", "$", "", digits(v))]
        while stack:
            x, path, scope, field, numbered = stack.pop()
            listed = type(x) is list
            for k, y in enumerate(x) if listed else x.items():
                if not listed and type(y) is str and k.endswith("_json"):
                    y = parse(y)
                if type(y) is not dict and type(y) is not list:
                    continue
                at = f"{path}[{k}]" if listed else f"{path}.{k}"
                name, own = (field if listed or numbered else k), None
                if type(y) is dict:
                    own = "" if listed or numbered else "[0]" if k in self.fields else None
                inner = scope
                if own is not None:
                    at += own
                    inner = at
                    values = None if self.values is None else [(n, _plain(z)) for n, z in y.items() if type(z) is not dict and type(z) is not list]
                    self.deep.append((at, at, scope, name, digits(y), values))
                stack.append((y, at, inner, name, digits(y)))

    def array(self) -> pa.Array:
        n = len(self.up)
        values = pa.nulls(n, pa.map_(pa.string(), pa.string())) if self.values is None else pa.array(self.values, pa.map_(pa.string(), pa.string()))
        flat = pa.StructArray.from_arrays(
            [pa.array(self.up, pa.int32()), pa.array(self.key, pa.string()), pa.array(self.idx, pa.int32()), pa.array(self.obj, pa.bool_()), pa.array(self.digits, pa.bool_()), values],
            NODE.names,
        )
        levels = pa.ListArray.from_arrays(pa.array(self.rows, pa.int32()), pa.ListArray.from_arrays(pa.array(self.levels, pa.int32()), flat))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()))
        children = pa.StructArray.from_arrays([pa.array([d[k] for d in self.deep], kind) for k, kind in enumerate(kinds)], CHILD.names)
        return pa.StructArray.from_arrays([levels, pa.ListArray.from_arrays(pa.array(self.deep_rows, pa.int32()), children)], SKELETON.names)


def skeletons_of_texts(values: bool = False, fields: tuple[str, ...] = ()):
    """Arrow function: the skeleton of each JSON text; no level for a text that isn't JSON. fields: the
    collections, which a deep text's walk has to know."""

    @F.arrow_udf(SKELETON)
    def skeleton(text: pa.Array) -> pa.Array:
        out = _Columns(values, fields)
        for s in text.to_pylist():
            out.add(parse(s))
        return out.array()

    return skeleton


def skeletons_of_bodies(values: bool = False, fields: tuple[str, ...] = ()):
    """Arrow function of (zlib body, size, sha256): the skeleton of each readable body."""

    @F.arrow_udf(SKELETON)
    def skeleton(data: pa.Array, size: pa.Array, digest: pa.Array) -> pa.Array:
        out = _Columns(values, fields)
        for x in zip(data.to_pylist(), size.to_pylist(), digest.to_pylist()):
            out.add(parse(body_text(inflate_checked(*x))))
        return out.array()

    return skeleton
