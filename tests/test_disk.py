"""What the claims queries leave on disk: shuffles and copies of the claims."""

import time
from datetime import date, datetime

import pytest

from lossframe.operators import numbering as N
from lossframe.operators.rules import RuleConfig
from lossframe.plans import claims_run as R
from lossframe.session import persist_table
from lossframe.sources import fixtures as X
from lossframe.streaming import claim_keys as CK


@pytest.fixture
def tables(spark, tmp_path):
    """Line items out of order, one order without a customer, one line item without an order."""
    day = datetime(2023, 3, 4, 5, 6)
    li = [(ok, pk, 50 if pk == 41 else 3, ln, 100.5 * ln, 0.1, 0.02, flag, "O", day)
          for ok, pk, ln, flag in [(67, 41, 1, "N"), (2, 5, 6, "A"), (11, 7, 3, "R"), (2, 4, 5, "A"), (97, 1, 2, "N"), (4, 1, 2, "N"), (9, 1, 1, "N")]]
    od = [(ok, ck, day) for ok, ck in [(2, 1), (11, 79), (67, 83), (97, 1), (4, 5)]]  # no customer 5, no order 9
    cu = [(ck, f"Customer#{ck}", ck % 8) for ck in (1, 79, 83)]
    for name, rows, schema in [
            ("lineitem", li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, "
                             "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
            ("orders", od, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
            ("customer", cu, "c_custkey long, c_name string, c_nationkey int")]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_orders_meet_customers_before_line_items(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = X.claims_raw(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("SortMergeJoin [l_orderkey") < plan.index("SortMergeJoin [o_custkey")  # the upper one comes first


def test_stored_claims_are_numbers_and_give_the_raw_view(spark, tables):
    stored = X.claims_stored(spark, tables)
    assert not {"row_key", "paid_amount", "date_of_loss", "policy_no"} & set(stored.columns)
    rows = [tuple(r) for r in X.claims_raw_table(spark, tables).drop(*X.ORDER_KEYS).orderBy("row_key").collect()]
    assert rows == [
        ("11-7-3-3", "C-11", "2023-03-04", "2023-03-04", "(301.50)", "(277.38)", "$ 24.12", None, "POL-79", "O", None, "R"),
        ("2-4-3-5", "C-2", "4-Mar-2023", "2023-03-04", "$ 502.50", "$ 462.30", "(39.20)", "usd", "POL-1", "O", "Customer#1", "A"),
        ("2-5-3-6", "C-2", "2023-03-04", "2023-03-04", "$ 603.00", "$ 554.76", None, "usd", "POL-1", "O", "Customer#1", "A"),
        ("67-41-50-1", "C-67", "04/03/2023", "2023-03-04", "$ 502.50", None, "$ 1005.00", "GBP", None, "O", "Customer#83", "N"),
        ("97-1-3-2", None, "4-Mar-2023", "2023-03-04", "$ 201.00", "$ 184.92", "(16.08)", "usd", "POL-1", "O", "Customer#1", "N")]
    std = {r["row_id"]: r["claim_id"] for r in X.claims_std(spark, tables).collect()}
    assert std == {1: "C-2", 2: "C-2", 3: "C-11", 4: "C-67", 5: None}


def test_line_items_of_equal_keys_stay_in_file_order(spark, tables):
    li = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_orderkey = 4")
    day = datetime(2023, 3, 4)
    spark.createDataFrame([(4, 1, 3, 2, float(p), 0.0, 0.0, "N", "O", day) for p in (7, 3, 9, 1)], li.schema).coalesce(1).write.mode("overwrite").parquet(
        f"{tables}/lineitem.parquet")
    spark.createDataFrame([(4, 1, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.mode("overwrite").parquet(f"{tables}/orders.parquet")
    assert [int(r["paid"]) for r in X.claims_std(spark, tables).orderBy("row_id").collect()] == [7, 3, 9, 1]


def test_shuffle_files_of_stored_tables_go(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    own = set()
    for parts in range(7, 27):  # the driver's memory may fill just now, then they are gone by themselves
        before = shuffles()
        spark.range(10000).repartition(parts, "id").write.format("noop").mode("overwrite").save()
        own = shuffles() - before
        if own:
            break
    until = time.time() + 20
    while own & shuffles() and time.time() < until:  # steps that store a table; the cleaner works beside them
        assert persist_table(spark.range(10), "t").count() == 10
    assert own and not own & shuffles()


def test_a_run_stores_its_claims_once(spark, tmp_path, monkeypatch):
    stored = []

    def kept(df, name="table"):
        stored.append((name, set(df.columns)))
        return persist_table(df, name)

    for module in (R, N):
        monkeypatch.setattr(module, "persist_table", kept)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Claim No,Date of Loss,Paid,Curr\nC1,2023-01-01,5,AUD\nC1,2023-01-01,6,\nC2,2023-01-02,7,AUD\n")
    res = R.process(spark, str(tmp_path / "in"), str(tmp_path / "store"), RuleConfig.only("rule_missing_currency"), run_id="r1")
    assert [name for name, columns in stored if "claimant" in columns] == ["numbered"]
    assert [(r.row, r.issue) for r in res.issues.collect()] == [(2, "Missing currency")]
    assert sorted((r.row_id, r.flags) for r in res.flagged.collect()) == [(1, None), (2, "Missing currency"), (3, None)]
    # rules on claim keys join the claims: their result is kept
    stored.clear()
    res = R.process(spark, str(tmp_path / "in"), str(tmp_path / "store"), RuleConfig.only("rule_duplicates"), run_id="r2")
    assert [name for name, columns in stored if "claimant" in columns] == ["numbered", "annotated"]
    assert [r.row for r in res.issues.collect()] == [2]


def test_keys_of_the_stream_carry_numbers_and_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Places are one number in files, state and shuffles, and come back as they were, also those of two files of one name."""
    day, task = date(2023, 1, 1), 1 << 33
    batches = [[("b.csv", 0, 1, 10, "A", day), ("a.csv", 0, 2 * task + 3, 11, "a", day), ("a.csv", 0, task, 12, "A", None),
                ("a.csv", 64, 3 * task, 13, None, day), ("a.csv", 0, task + 1, 14, "X", day), ("a.csv", 0, 2 * task, 15, "Y", None)],
               [("a.csv", 0, 0, 16, "X", None), ("c.csv", 0, 1, 17, None, day), ("c.csv", 0, 2, 18, "a", day)]]
    plans, real, root = {}, CK.publish, str(tmp_path)

    def kept(df, path, batch_id):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        real(df, path, batch_id)

    monkeypatch.setattr(CK, "publish", kept)
    for n, rows in enumerate(batches):
        std = spark.createDataFrame(rows, f"source_file string, `{N.BLOCK}` long, `{N.POSITION}` long, row_hash long, claim_id string, loss_date date")
        CK.publish_rows(std, root, n)
        assert plans["digests"].count("Exchange hashpartitioning") == 1
        CK.start(spark, root, f"{root}/out", f"{root}/ck").awaitTermination()
    texts = [f.name for f in spark.read.parquet(f"{root}/digests/batch-{0:012d}").schema if f.dataType.simpleString() not in ("int", "bigint", "date")]
    assert texts == ["k1"]
    got = [(r.batch_id, r.source_file, r.block, r.position, r.row_hash, r.claim_id, r.rule_order, r.detail[:3]) for r in CK.set_issues(spark, f"{root}/out").collect()]
    rule = {8: "dup", 19: "n=2"}
    assert sorted(got, key=str) == sorted([(b, *batches[b][i][:5], k, rule[k]) for b, i, k in [
        (0, 0, 8), (1, 1, 8), (1, 2, 8), (0, 0, 19), (0, 2, 19), (0, 3, 19), (1, 1, 19), (0, 4, 19), (1, 0, 19), (0, 1, 19), (1, 2, 19)]], key=str)
