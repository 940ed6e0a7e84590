"""Layout tables: spans, blank rows, overlaps against a grid filled position by position."""

import json
import random

import pytest

from lossframe.sources import layout as L


def grid(table):
    """The rows of one table, filled cell by cell and position by position."""
    nr, nc = table.get("rowCount") or 0, table.get("columnCount") or 0
    if nr <= 0 or nc <= 0 or not table.get("cells"):
        return []
    out = [[""] * nc for _ in range(nr)]
    for c in table["cells"]:
        r0, c0 = c.get("rowIndex"), c.get("columnIndex")
        if r0 is None or c0 is None or not 0 <= r0 < nr or not 0 <= c0 < nc:
            continue
        value = c.get("content") if c.get("content") is not None else (c.get("text") or "")
        for r in range(r0, min(nr, r0 + max(1, c.get("rowSpan") or 1))):
            for k in range(c0, min(nc, c0 + max(1, c.get("columnSpan") or 1))):
                out[r][k] = out[r][k] or value
    return out


def doc(*tables):
    return json.dumps({"analyzeResult": {"tables": list(tables)}})


def read(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, json string, value string, at long")
    out = {}
    for r in L.layout_rows(df).collect():
        out.setdefault((r.doc_id, r.table_no), {}).setdefault(r.row_no, []).append(list(r.cells))
    return out


def cell(r, c, text, rs=None, cs=None):
    return {"rowIndex": r, "columnIndex": c, "content": text} | ({"rowSpan": rs} if rs else {}) | ({"columnSpan": cs} if cs else {})


def test_random_tables_equal_the_grid(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for i in range(40):
        tables = []
        for t in range(rnd.randint(1, 3)):
            nr, nc = rnd.randint(1, 12), rnd.randint(1, 6)
            cells = [cell(rnd.randint(-1, nr), rnd.randint(-1, nc), rnd.choice(["", "a", "b", f"x{k}"]),
                          rnd.choice([None, None, 2, 5, -3, 2_000_000_000]), rnd.choice([None, None, 2, 2_000_000_000]))
                     for k in range(rnd.randint(1, 25))]
            tables.append({"rowCount": nr, "columnCount": nc, "cells": cells})
            want[(f"d{i}", t)] = {r: [row] for r, row in enumerate(grid(tables[-1]))}
        rows.append((f"d{i}", doc(*tables), "x", 1))
    assert read(spark, rows) == want


def test_spans_blank_rows_and_cases(spark):
    tall = {"rowCount": 10, "columnCount": 1, "cells": [cell(0, 0, "x", 10)]}
    gaps = {"rowCount": 5, "columnCount": 2, "cells": [cell(0, 0, "a"), cell(2, 1, "b")]}
    empty = {"rowCount": 3, "columnCount": 1, "cells": []}
    odd = {"rowCount": 1, "columnCount": 1, "cells": [{"rowIndex": None, "columnIndex": 0, "content": "no"}, {"text": "no"}]}
    rows = [("t", doc(tall), "", 1), ("g", doc(gaps, empty, odd), "", 1), (None, doc(tall), "", 1), ("n", None, "", 1), ("j", "no json", "", 1),
            ("same", doc(tall), "", 1), ("same", doc(gaps), "", 1), ("twice", doc(odd), "", 1), ("twice", doc(odd), "", 1)]
    got = read(spark, rows)
    assert [got["t", 0][r] for r in range(10)] == [[["x"]]] * 10 and got[None, 0] == got["t", 0]
    assert [got["g", 0][r][0] for r in range(5)] == [["a", ""], ["", ""], ["", "b"], ["", ""], ["", ""]]
    assert got["g", 2] == {0: [[""]]} and ("g", 1) not in got and ("n", 0) not in got and ("j", 0) not in got
    assert sorted(map(len, got["same", 0].values())) == [1] * 5 + [2] * 5 and got["twice", 0] == {0: [[""], [""]]}
    assert L.layout_tables(spark.createDataFrame([], "doc_id string, json string")).count() == 0


def test_absurd_counts_name_the_document(spark):
    many = {"rowCount": 2_000_000_000, "columnCount": 3, "cells": [cell(0, 0, "x")]}
    df = spark.createDataFrame([("inv-7", doc(many))], "doc_id string, json string")
    with pytest.raises(Exception, match="layout document inv-7, table 0: 2000000000 rows"):
        L.layout_tables(df).collect()
    wide = {"rowCount": 1, "columnCount": 2_000_000, "cells": [cell(0, 0, "x")]}
    with pytest.raises(ValueError, match="layout document inv-8"):
        L.layout_tables(spark.createDataFrame([("inv-8", doc(wide))], "doc_id string, json string"))


def test_plan_explodes_no_positions(spark):
    """A table whose one cell spans a million rows: cells are matched by bands, of which there is one."""
    big = {"rowCount": 1_000_000, "columnCount": 2, "cells": [cell(0, 0, "x", 2_000_000_000, 2)]}
    df = spark.createDataFrame([("b", doc(big))], "doc_id string, json string")
    rows = L.layout_rows(df)
    assert rows.count() == 1_000_000 and rows.where("cells[1] <> 'x'").count() == 0
