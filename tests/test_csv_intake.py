"""CSV intake by position: rejects, dialects, header spellings, many headers in one plan, promotion."""

import io
import csv
import random

import pytest

from lossframe.sources import csv_intake as C
from lossframe.sources import files as S


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_no_cell_is_lost(spark, tmp_path):
    write(tmp_path / "a.csv", 'a,b\n1,2\n1,2,3\n"x, ""y""",4\n5\n"p, q",6,,\n7,"line\nbreak",8\n')
    write(tmp_path / "b.csv", "\n\n  \nPaid,PAID,,Paid\n1,2,3,4\n1,2,3,4,\n")
    df = S.read_csv(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in df.where("source_file = 'a.csv'").collect()) == [("1", "2"), ("5", None), ('x, "y"', "4")]
    assert [c for c in df.columns if c not in ("a", "b", "source_file")] == ["Paid", "PAID1", "_c2", "Paid3"]
    assert [tuple(r)[2:6] for r in df.where("source_file = 'b.csv'").collect()] == [("1", "2", "3", "4")]
    gone = rows(C.csv_rejects(spark, str(tmp_path)), "source_file", "record_no", "reason", "record")
    assert gone == [("a.csv", 2, "3 cells under a header of 2", "1,2,3"), ("a.csv", 5, "4 cells under a header of 2", '"p, q",6,,'),
                    ("a.csv", 6, "3 cells under a header of 2", '7,"line\nbreak",8'),
                    ("b.csv", 2, "5 cells under a header of 4", "1,2,3,4,")]


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_dialects_read_alike(spark, tmp_path, delimiter, quote):
    rnd = random.Random(4)
    table = [["claim no", "paid", "note"]] + [
        [f"C-{i}", f"{rnd.randint(1, 999)},{rnd.randint(10, 99)}", rnd.choice(["plain", "a, b; c", "tab\there", "pipe | x", f"q {quote} q"])]
        for i in range(60)]
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quotechar=quote, lineterminator="\n").writerows(table)
    write(tmp_path / "x.csv", out.getvalue())
    assert C.detect_dialect(out.getvalue().encode()) == (delimiter, quote)
    got = rows(S.read_csv(spark, str(tmp_path), with_lineage=False), "`claim no`", "paid", "note")
    assert got == sorted(map(tuple, table[1:]))


def test_dialect_of_odd_files():
    assert C.detect_dialect(b"one\n1\n2\n") == (",", '"')
    assert C.detect_dialect(b"") == (",", '"')
    assert C.detect_dialect("﻿a;b\n1,5;2,5\n3,5;4\n".encode()) == (";", '"')
    assert C.detect_dialect(b"name,text\no'neil,it's\nx,y\n") == (",", '"')


def test_many_headers_one_scan(spark, tmp_path, capsys):
    """300 files, each with a header of its own: the plan is that of two files."""
    def plan(folder):
        df = S.read_csv(spark, str(folder), with_lineage=False).select("id", "v0")
        df.explain("simple")
        return capsys.readouterr().out, df

    for n in (2, 300):
        (tmp_path / str(n)).mkdir()
        for i in range(n):
            names = ["id", f"v{i}", f"w{i}"]
            random.Random(i).shuffle(names)
            cells = {"id": str(i), f"v{i}": f"x{i}", f"w{i}": "w"}
            write(tmp_path / str(n) / f"{i:03}.csv", ",".join(names) + "\n" + ",".join(cells[c] for c in names) + "\n")
    small, _ = plan(tmp_path / "2")
    large, df = plan(tmp_path / "300")
    assert large.count("FileScan csv") == small.count("FileScan csv") == 1
    assert large.count("Join") == small.count("Join")
    got = dict(rows(df, "id", "v0"))
    assert len(got) == 300 and got["0"] == "x0" and all(v is None for k, v in got.items() if k != "0")


def test_names_of_any_case_are_one_column(spark, tmp_path):
    write(tmp_path / "a.csv", "Claim,Paid\nA,1\n")
    write(tmp_path / "b.csv", "PAID;claim\n2;B\n")
    df = S.read_csv(spark, str(tmp_path))
    assert df.columns == ["Claim", "Paid", "source_file"]
    assert rows(df, "Claim", "Paid", "source_file") == [("A", "1", "a.csv"), ("B", "2", "b.csv")]


def test_intake_promotes_and_numbers(spark, tmp_path):
    from lossframe.plans.claims_run import intake

    write(tmp_path / "a.csv", "x;y\nclaim_id;paid\nA1;9\nA2;8;7\nA3;6\n")
    write(tmp_path / "b.csv", "u,v\nPaid,Claim No\n5,B1\nPaid,Claim No\n")
    write(tmp_path / "c.csv", "claim_id,paid\nonly,1\n")  # one data row: nothing would be left below a promoted header
    std, _ = intake(spark, str(tmp_path), promote=True)
    got = [(r.row_id, r.source_file, r.claim_id, None if r.paid is None else int(r.paid)) for r in std.orderBy("row_id").collect()]
    assert [g[1:] for g in got] == [("a.csv", "A1", 9), ("a.csv", "A3", 6), ("b.csv", "B1", 5), ("b.csv", "Claim No", None),
                                    ("c.csv", "only", 1)]
    assert len({g[0] for g in got}) == 5


def test_no_header_at_all(spark, tmp_path):
    write(tmp_path / "a.csv", "\n\n")
    with pytest.raises(ValueError, match="no CSV file with a header"):
        S.read_csv(spark, str(tmp_path))
    write(tmp_path / "b.csv", "a,b\n")
    assert S.read_csv(spark, str(tmp_path)).count() == 0 and C.csv_rejects(spark, str(tmp_path)).count() == 0


def test_promotion_of_many_headers_is_one_plan(spark, capsys):
    def plan(n):
        data = [(0, f"f{i}", "Claim", f"N{i}") for i in range(n)] + [(1, f"f{i}", f"c{i}", "v") for i in range(n)]
        out = S.promote_header(spark.createDataFrame(data, "line int, f string, a string, b string"), True, "line", "f")
        out.select("f", "Claim", "N0").explain("simple")
        return capsys.readouterr().out.count("Join"), out

    joins, _ = plan(2)
    many, out = plan(150)
    assert joins == many and out.count() == 150
    assert rows(out.where("f = 'f7'"), "Claim", "N7", "N8") == [("c7", "v", None)]


def test_streamed_columns_are_found_by_name(spark, tmp_path):
    """Two files with swapped headers, one in another dialect, one without a column, a record too wide: the stream reads them as the batch does."""
    from lossframe.streaming.ingest import read_landed, start

    land = tmp_path / "land"
    land.mkdir()
    write(land / "a.csv", 'claim,paid,ccy\n"C\n1",-5,USD\n')
    write(land / "b.csv", "PAID;Claim\n-7;C2\n-8;C3;x\n")
    write(land / "c.csv", "\n")
    rows, rejects = read_landed(spark, [f"{land}/{n}.csv" for n in "abc"], ["claim", "paid", "ccy"])
    assert [tuple(r) for r in rows.orderBy("_file").collect()] == [("C\n1", "-5", "USD", "a.csv"), ("C2", "-7", None, "b.csv")]
    assert [tuple(r) for r in rejects.collect()][0][:2] == ("b.csv", "3 cells under a header of 2")
    out = str(tmp_path / "issues")
    start(spark, str(land), ["claim", "paid", "ccy"], {"claim_id": "claim", "paid": "paid", "currency": "ccy"}, out,
          str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out).where("issue = 'Negative paid'")
    assert rows_of(got) == [("a.csv", "C\n1"), ("b.csv", "C2")]
    assert spark.read.parquet(out + "-rejects").count() == 1


def rows_of(df):
    return rows(df, "source_file", "claim_id")
