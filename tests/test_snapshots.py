import json
import random

import pytest

from lakeloom.functions.payloads import canonical_text
from lakeloom.operators import snapshots

PINS = "scan_id string, pin_id string, page int, title string, description string, image_signature string, board_id string, fields_json string, observed_at timestamp"
SCANS = "scan_id string, entrypoint string, subject_id string, state string, updated_at timestamp"


def ts(n):
    import datetime

    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def pin(scan, pin_id, title="t", fields="{}", at=0):
    return (scan, pin_id, 0, title, None, None, None, fields, ts(at))


def run(spark, tmp_path, scans, pins):
    spark.createDataFrame(scans, SCANS).write.mode("overwrite").parquet(f"{tmp_path}/pinterest_streams.parquet")
    spark.createDataFrame(pins, PINS).write.mode("overwrite").parquet(f"{tmp_path}/pinterest_stream_pins.parquet")
    return sorted((r.prev_scan_id, r.scan_id, r.pin_id, r.change) for r in snapshots.p4_found(spark, str(tmp_path)).collect())


def test_cases(spark, tmp_path):
    s = lambda i, at, state="exhausted", e="x": (i, e, "s", state, ts(at))
    scans = [s("1", 10), s("2", 20), s("2", 20), s("bad", 25, "failed"), s("3", 30), s("4", 40), s("n1", 5, e=None), s("n2", 6, e=None)]
    pins = [
        pin("1", "a"), pin("1", "b"), pin("1", "b"), pin("1", "c", fields='{"n": 1, "x": null, "counts": {"s": 1}}'), pin("1", "d", title=None), pin("bad", "z"), pin("none", "z"), pin("1", None),
        pin("2", "a", at=9), pin("2", "a", title="late", at=3), pin("2", "c", fields='{"tracking":"q","n":1.0}'), pin("2", "d", title=""), pin("2", "e"),
        pin("4", "e"), pin("n1", "a"), pin("n2", "a", fields="[1]"),
    ]
    want = [("1", "2", "b", "removed"), ("1", "2", "d", "changed"), ("1", "2", "e", "added"), *[("2", "3", p, "removed") for p in "acde"], ("3", "4", "e", "added"), ("n1", "n2", "a", "changed")]
    assert run(spark, tmp_path, scans, pins) == sorted(want)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []


@pytest.mark.parametrize("rows_at_once", [1, 7, 300_000])
def test_random_against_sets(spark, tmp_path, monkeypatch, rows_at_once):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", rows_at_once)
    rng = random.Random(3)
    scans = [(f"{e}{k}", "x", e, "exhausted", ts(k)) for e in "ab" for k in range(6)]
    pins = [pin(sc[0], str(rng.randrange(30)), rng.choice("tu"), json.dumps({"k": rng.randrange(2)}), rng.randrange(1000)) for sc in scans for _ in range(25)]
    best = {}
    for p in pins:
        if (p[0], p[1]) not in best or best[p[0], p[1]][8] < p[8]:
            best[p[0], p[1]] = p
    pins = [p for p in pins if sum(q[:2] == p[:2] and q[8] == p[8] for q in pins) == 1]  # no ties
    best = {}
    for p in pins:
        if (p[0], p[1]) not in best or best[p[0], p[1]][8] < p[8]:
            best[p[0], p[1]] = p
    want = []
    for e in "ab":
        for k in range(1, 6):
            a, b = ({i: (p[3], p[7]) for (sc, i), p in best.items() if sc == f"{e}{n}"} for n in (k - 1, k))
            want += [(f"{e}{k - 1}", f"{e}{k}", i, "added" if i not in a else "removed" if i not in b else "changed") for i in a.keys() | b.keys() if a.get(i) != b.get(i)]
    assert run(spark, tmp_path, scans, pins) == sorted(want)


def test_a_key_in_every_snapshot(spark, tmp_path, monkeypatch):
    """A pin of one stream that is in all its scans goes through many buckets; streams don't mix."""
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 5)
    scans = [(f"{e}{k:03d}", "x", e, "exhausted", ts(k)) for e in "ab" for k in range(200)]
    pins = [pin(sc[0], "p", "t" if int(sc[0][1:]) % 7 else "u", at=n) for sc in scans for n in range(3) if int(sc[0][1:]) % 50 != 9]
    want = []
    for e in "ab":
        for k in range(1, 200):
            a, b = (None if n % 50 == 9 else bool(n % 7) for n in (k - 1, k))
            if a != b:
                want.append((f"{e}{k - 1:03d}", f"{e}{k:03d}", "p", "added" if a is None else "removed" if b is None else "changed"))
    assert run(spark, tmp_path, scans, pins) == sorted(want)
    full = snapshots.p4_values(spark, str(tmp_path))
    assert sorted((r.prev_scan_id, r.scan_id, r.pin_id, r.change) for r in full.collect()) == sorted(want)
    assert {r.title for r in full.where("change <> 'removed' AND scan_id LIKE '%014'").collect()} == {"u"}


def test_canonical_text():
    same = ['{"a":1,"b":[1,2]}', ' {"b":[1.0,2],"a":1.0,"c":null}', '{"\\u0061":1,"b":[1,2.0]}']
    assert len({canonical_text(x) for x in same}) == 1
    other = ['{"a":1,"b":[2,1]}', '{"a":"1","b":[1,2]}', '{"a":true,"b":[1,2]}', "", "not json", "null", '{"a":1,"b":[1,2,null]}']
    assert len({canonical_text(x) for x in [same[0], *other]}) == len(other) + 1 and canonical_text(None) is None
