"""Compare a query with its SQL: the same rows, however often, in any order."""

import datetime
import decimal
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, duck, sql, empty=False):
    cols = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == cols
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = Counter(tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
    assert got or empty, "nothing was compared"
