"""The registered queries of this package and their SQL; each query lives in a module ``q_*``."""
from __future__ import annotations

import importlib
import pkgutil
from pathlib import Path

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load():
    here = str(Path(__file__).resolve().parent)
    for m in sorted(x.name for x in pkgutil.iter_modules([here]) if x.name.startswith("q_")):
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(SQL)
