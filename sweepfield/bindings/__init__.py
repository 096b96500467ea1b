"""Registered queries on the driver tables, each next to the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("voxel", "geometry", "neighbor", "temporal", "score", "shape", "ray", "rasters", "sample", "stream", "source", "plan")


def collect():
    """All registered queries and their SQL, by name."""
    from .registry import QUERIES, SQL

    for family in FAMILIES:
        import_module(f"{__name__}.{family}_queries")
    return dict(QUERIES), dict(SQL)
