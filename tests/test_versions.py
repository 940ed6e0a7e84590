"""Stored tables under crashes and several writers."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
import os

import pytest

from lossframe.operators import history as H
from lossframe.operators import mapping as M
from lossframe.operators import versions as W

T0 = datetime(2024, 1, 1)


def maps(spark, *rows):
    return spark.createDataFrame(list(rows), M.MAPPING_STORE_SCHEMA)


def stored(spark, root):
    return {(r.tenant_id, r.counterparty, r.mapping_json) for r in H.read_table(spark, root, "saved_mappings", M.MAPPING_STORE_SCHEMA).collect()}


class Crash(Exception):
    pass


def crash(*_):
    raise Crash


def test_crash_between_data_and_pointer_keeps_the_old_store(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    M.store_mappings(spark, root, maps(spark, ("t", "a", "1", T0)))
    monkeypatch.setattr(W, "_claim", crash)
    with pytest.raises(Crash):
        M.store_mappings(spark, root, maps(spark, ("t", "b", "2", T0)))
    with pytest.raises(Crash):
        H.append_audit(spark, root, "x", {})
    monkeypatch.undo()
    assert stored(spark, root) == {("t", "a", "1")} and H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA).count() == 0
    M.store_mappings(spark, root, maps(spark, ("t", "b", "2", T0)))
    assert stored(spark, root) == {("t", "a", "1"), ("t", "b", "2")}
    left = f"{root}/saved_mappings"
    assert W.drop_unused(spark, left) == 0  # too young: it might be a writer's
    assert W.drop_unused(spark, left, 0) == 2 and stored(spark, root) == {("t", "a", "1"), ("t", "b", "2")}


def test_a_faster_writer_is_not_lost(spark, tmp_path):
    table, schema = f"{tmp_path}/t", M.MAPPING_STORE_SCHEMA
    tries = []

    def build(old):
        if not tries:  # another commit between our read and our claim
            W.append(spark, table, schema, maps(spark, ("t", "other", "1", T0)))
        tries.append(1)
        return M.upsert(old, maps(spark, ("t", "own", "2", T0)))

    assert W.replace(spark, table, schema, build) == 2 and len(tries) == 2
    assert {r.counterparty for r in W.read(spark, table, schema).collect()} == {"own", "other"}
    # a reader's files go while it builds: it starts again from the new version
    tries.clear()

    def pulled(old):
        tries.append(1)
        if len(tries) == 1:
            W.replace(spark, table, schema, lambda d: d.where("counterparty = 'own'"))
            W.drop_retired(spark, table)
        return old

    W.replace(spark, table, schema, pulled)
    assert len(tries) == 2 and [r.counterparty for r in W.read(spark, table, schema).collect()] == ["own"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(M.store_mappings, spark, root, maps(spark, ("t", f"c{i}", str(i), T0))) for i in range(4)]
        jobs += [pool.submit(H.append_audit, spark, root, f"e{i}", {"i": i}) for i in range(4)]
        [j.result() for j in jobs]
    assert stored(spark, root) == {("t", f"c{i}", str(i)) for i in range(4)}
    assert {r.event for r in H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA).collect()} == {f"e{i}" for i in range(4)}


def test_claim_is_exclusive(spark, tmp_path):
    os.makedirs(f"{tmp_path}/{W.VERSIONS}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: W._claim(spark, str(tmp_path), 1, [f"f{i}"]), range(8)))
    assert sum(won) == 1 and W.current(spark, str(tmp_path)) == (1, [f"f{won.index(True)}"])


def test_many_appends_are_merged_and_pruned_for_good(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(W, "MERGE_AT", 3)
    for i in range(8):
        H.append_audit(spark, root, f"e{i}", {"i": i})
    table = f"{root}/audit_log"
    names = W.current(spark, table)[1]
    assert len([n for n in names if n.startswith(W.ONE)]) <= 3 and len(names) <= 4
    assert sorted(r.event for r in H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA).collect()) == [f"e{i}" for i in range(8)]
    assert H.prune(spark, root)["audit_log"] == 0 and W.current(spark, table)[1] == names
    assert H.prune(spark, root, as_of=datetime.now() + timedelta(days=60))["audit_log"] == 8
    assert H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA).count() == 0
    assert not any(n in os.listdir(table) for n in names)  # expired rows are off the disk


def test_plain_folder_of_an_earlier_release_is_version_0(spark, tmp_path):
    root = str(tmp_path)
    maps(spark, ("t", "a", "1", T0)).write.parquet(f"{root}/saved_mappings")
    assert stored(spark, root) == {("t", "a", "1")}
    M.store_mappings(spark, root, maps(spark, ("t", "b", "2", T0)))
    assert stored(spark, root) == {("t", "a", "1"), ("t", "b", "2")}
    H.delete_all(spark, root, confirm=True)
    assert stored(spark, root) == set() and not [n for n in os.listdir(f"{root}/saved_mappings") if n.startswith("part-")]
