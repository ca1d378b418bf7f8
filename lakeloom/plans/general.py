"""Queries on the general problems of the training-data pipeline."""

from __future__ import annotations

from lakeloom.operators import nested, schemas, snapshots

QUERIES = {
    "p1_found": nested.p1_found,
    **{f"p1_{name}": lambda spark, d, name=name: nested.tables(spark, d, [name])[name] for name in nested.TABLES},
    "p1_linked": nested.p1_linked,
    "p3_found": schemas.p3_found,
    "p3_unified": schemas.p3_unified,
    "p4_found": snapshots.p4_found,
    "p4_values": snapshots.p4_values,
}
SQL: dict[str, str] = {}
