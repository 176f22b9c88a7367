from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from foliomine.session import local_session

    return local_session(cores="4", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def oracle(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(oracle):
    """Whether a frame and a SQL text give the same rows, however often each."""

    def check(frame, sql: str) -> None:
        ours = frame.toArrow()
        theirs = oracle.sql(sql).to_arrow_table()
        assert sorted(ours.column_names) == sorted(theirs.column_names)
        columns = ", ".join(f'"{c}"' for c in sorted(ours.column_names))
        oracle.register("ours", ours)
        oracle.register("theirs", theirs)
        for a, b in (("ours", "theirs"), ("theirs", "ours")):
            assert oracle.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []

    return check
