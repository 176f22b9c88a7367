"""The queries over the test tables: columns, SQL twins, and that the rest of the library does without them."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest

from foliomine.llm import queries as Q

COLUMNS = {
    "p1_found": ["log_id", "defect"],
    "p2_found": ["log_id", "field_name", "pii_type", "start_pos"],
    "p3_found": ["table_id", "field_name", "markup"],
    "p4_found": ["rec_table", "rec_id", "text_class"],
    "p5_found": ["block_id", "line_no"],
    "p6_found": ["rec_table", "rec_id", "char_kind"],
    "p7_found": ["rec_table", "rec_id", "noise_kind"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark, data):
    frame = Q.queries()[name](spark, data)
    rows = frame.count()
    if name in COLUMNS:
        assert frame.columns == COLUMNS[name]
        assert frame.distinct().count() == rows > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(name, spark, data, same):
    same(Q.queries()[name](spark, data), Q.oracle_sql()[name])


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "foliomine")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", f.read(), re.M), name
    code = "import sys; sys.modules['foliomine.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'hybrid_topk' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
