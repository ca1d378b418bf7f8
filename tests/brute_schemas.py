"""An independent, plain reading of the rules for schema changes."""

import hashlib
import json
import re
import zlib

import pyarrow as pa


def _plain(t):
    if pa.types.is_dictionary(t):
        return _plain(t.value_type)
    if t == pa.large_string():
        return pa.string()
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _plain(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(_plain(t.value_type))
    return t


def _diff_type(a, b, x, y, out):
    a, b = (t.value_type if pa.types.is_dictionary(t) else t for t in (a, b))
    if pa.types.is_struct(a) and pa.types.is_struct(b):
        _diff_fields(list(a), list(b), x + ".", y + ".", out)
    elif pa.types.is_list(a) and pa.types.is_list(b):
        _diff_type(a.value_type, b.value_type, x + "[]", y + "[]", out)
    elif _plain(a) != _plain(b):
        out.append(("retyped", x, y))


def _diff_fields(old, new, x, y, out):
    norm = lambda f: re.sub("[^a-z0-9]", "", f.name.lower())
    fid = lambda f: (f.metadata or {}).get(b"PARQUET:field_id")
    rules = [
        ("", lambda a, b: a.name == b.name), ("renamed", lambda a, b: fid(a) is not None and fid(a) == fid(b)),
        ("renamed", lambda a, b: a.name in json.loads((b.metadata or {}).get(b"aliases", b"[]"))), ("renamed", lambda a, b: norm(a) == norm(b)),
    ]
    old, new = list(old), list(new)
    for change, rule in rules:
        for a in list(old):
            for b in list(new):
                if rule(a, b):
                    old.remove(a)
                    new.remove(b)
                    if change:
                        out.append((change, x + a.name, y + b.name))
                    _diff_type(a.type, b.type, x + a.name, y + b.name, out)
                    break
    out += [("removed", x + a.name, "") for a in old] + [("added", "", y + b.name) for b in new]


def changes(schemas, uses, captures):
    """schemas: (id, ipc); uses: (raw_row, id); captures: (endpoint, adapter_version, status, error, format, zlib, bytes, sha)."""
    found, lineages = set(), {}
    first = {}
    for row, i in uses:
        first[i] = min(row, first.get(i, row))
    for i, b in dict(schemas).items():
        try:
            s = pa.ipc.read_schema(pa.BufferReader(b))
        except Exception:
            continue
        if i in first:
            lineages.setdefault(s.metadata[b"source_key"].decode(), []).append((first[i], i, s))
    for key, versions in lineages.items():
        versions.sort(key=lambda v: v[0])
        for (_, i, a), (_, j, b) in zip(versions, versions[1:]):
            out = []
            _diff_fields(list(a), list(b), "", "", out)
            found |= {(key, i, j, *c) for c in out}
    caps = {}
    for endpoint, version, status, error, fmt, z, n, h in captures:
        if status != 200 or error is not None or fmt != "json":
            continue
        try:
            body = zlib.decompress(z)
            assert len(body) == n and hashlib.sha256(body).hexdigest() == h
            v = json.loads(body.decode().removeprefix("﻿"))
        except Exception:
            continue
        p = v.get("body") if v.get("body") is not None else v.get("resource_response", {}).get("data")
        fields = caps.setdefault(endpoint, {}).setdefault(version, {})
        for q in p if isinstance(p, list) else [p]:
            for k, x in q.items() if isinstance(q, dict) else ():
                t = fields.setdefault(k, set())
                if x is None or x == [] or x == {}:
                    continue
                t.add("boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "nested")
    for endpoint, versions in caps.items():
        order = sorted(versions, key=lambda v: (int(re.search(r"\d+$", v)[0]), v))
        for i, j in zip(order, order[1:]):
            a, b = versions[i], versions[j]
            pairs = [(k, k) for k in a if k in b]
            norm = lambda k: re.sub("[^a-z0-9]", "", k.lower())
            rest = [k for k in b if k not in a]
            for k in [k for k in a if k not in b]:
                m = next((r for r in rest if norm(r) == norm(k)), None)
                if m is not None:
                    rest.remove(m)
                    pairs.append((k, m))
                    found.add((f"captures:{endpoint}", i, j, "renamed", k, m))
                else:
                    found.add((f"captures:{endpoint}", i, j, "removed", k, ""))
            found |= {(f"captures:{endpoint}", i, j, "added", "", r) for r in rest}
            found |= {(f"captures:{endpoint}", i, j, "retyped", x, y) for x, y in pairs if a[x] and b[y] and a[x] != b[y]}
    return found
