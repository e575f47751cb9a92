import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tributary.operators.changes import CHANGE_OP, apply_changes
from tributary.sources.tables import KEY_BUCKET, read_raw
from tributary.storage import Folder
from tributary.streaming.current import CurrentTable, keep_current, replica

BASE = "k INT, t INT, v STRING"
CHANGES = f"{BASE}, {CHANGE_OP} STRING"


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 9, "c"), (5, 4, "e")], BASE)
    changes = spark.createDataFrame(
        [(1, 2, "a2", "U"), (2, 2, None, "D"), (3, 8, "late", "U"), (4, 1, "d", "I"), (5, 4, "same age", "U")], CHANGES
    )
    assert rows_of(apply_changes(base, changes, ["k"], ["t"])) == [
        (1, 2, "a2"), (3, 9, "c"), (4, 1, "d"), (5, 4, "same age"),
    ]


def test_a_late_change_does_not_revive_a_deleted_key(spark, folder):
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=4)
    table.merge(spark.createDataFrame([(1, 5, None, "D"), (2, 1, "b", "I")], CHANGES))
    table.merge(spark.createDataFrame([(1, 3, "late", "U")], CHANGES))
    assert rows_of(table.read(spark)) == [(2, 1, "b")]


def test_any_order_of_batches_gives_the_batch_result(spark, folder):
    chance = random.Random(5)
    changes = [(chance.randrange(30), t, f"v{t}", chance.choice("IUD")) for t in range(200)]
    base = spark.createDataFrame([(k, -1, f"base{k}") for k in range(20)], BASE)
    expected = rows_of(apply_changes(base, spark.createDataFrame(changes, CHANGES), ["k"], ["t"]))
    chance.shuffle(changes)
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=8)
    table.merge(base.withColumn(CHANGE_OP, F.lit(None).cast("string")))
    for start in range(0, 200, 70):
        table.merge(spark.createDataFrame(changes[start:start + 70], CHANGES))
    assert rows_of(table.read(spark)) == expected


def test_a_batch_rewrites_only_its_buckets(spark, folder):
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=8)
    table.merge(spark.createDataFrame([(k, 0, "old") for k in range(50)], BASE))
    before = {b: Folder(spark, f"{table._content}/{KEY_BUCKET}={b}").names() for b in range(8)}
    table.merge(spark.createDataFrame([(7, 1, "new")], BASE))
    after = {b: Folder(spark, f"{table._content}/{KEY_BUCKET}={b}").names() for b in range(8)}
    assert sum(before[b] != after[b] for b in range(8)) == 1
    assert table.read(spark).filter("v = 'new'").count() == 1 and table.read(spark).count() == 50


def test_the_same_batch_again_changes_nothing(spark, folder):
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), ("v",), buckets=4)
    batch = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "c")], BASE)
    table.merge(batch)
    first = rows_of(table.read(spark))
    table.merge(batch)
    assert rows_of(table.read(spark)) == first == [(1, 1, "b"), (2, 1, "c")]


def test_a_replacement_cut_short_is_finished_by_the_next_run(spark, folder, monkeypatch):
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=4)
    table.merge(spark.createDataFrame([(k, 0, "old") for k in range(20)], BASE))
    put_in_place = CurrentTable._put_in_place
    calls = []

    def dies_on_the_second_call(self, session):
        calls.append(1)
        if len(calls) == 2:
            # Some buckets are gone, as when the driver dies while moving files.
            for name in Folder(session, self._content).names()[:2]:
                Folder(session, f"{self._content}/{name}").remove()
            raise RuntimeError("driver lost")
        put_in_place(self, session)

    batch = spark.createDataFrame([(k, 1, "new") for k in range(20)], BASE)
    monkeypatch.setattr(CurrentTable, "_put_in_place", dies_on_the_second_call)
    with pytest.raises(RuntimeError):
        table.merge(batch)
    monkeypatch.undo()
    table.merge(spark.createDataFrame([(99, 0, "other")], BASE))
    table.merge(batch)
    assert rows_of(table.read(spark), "k", "v") == sorted(
        [(k, "new") for k in range(20)] + [(99, "other")], key=lambda r: (str(r[0]), r[1])
    )


def test_stream_into_a_replica_that_the_refresh_reads(spark, folder):
    ddl = "transaction_id INT, seq INT, amount DECIMAL(10,2), " + f"{CHANGE_OP} STRING"
    source = f"{folder}/changes"
    first = spark.createDataFrame([(1, 1, None, "I"), (2, 2, None, "I")], ddl)
    first.write.mode("append").parquet(source)
    table = replica(f"{folder}/wh", "transactions", ("seq",), buckets=4)

    def run():
        stream = spark.readStream.schema(ddl).parquet(source)
        keep_current(stream, table, f"{folder}/checkpoint").awaitTermination()
        return rows_of(read_raw(spark, table.path), "transaction_id", "seq")

    assert run() == [(1, 1), (2, 2)]
    assert run() == [(1, 1), (2, 2)]
    spark.createDataFrame([(2, 3, None, "D"), (3, 4, None, "I")], ddl).write.mode("append").parquet(source)
    assert run() == [(1, 1), (3, 4)]


def test_another_number_of_buckets_is_an_error(spark, folder):
    batch = spark.createDataFrame([(1, 1, "a")], BASE)
    CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=8).merge(batch)
    with pytest.raises(ValueError, match="has 8 buckets, not 16"):
        CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=16).merge(batch)


def test_keys_of_another_type_meet_their_rows(spark, folder):
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=8)
    table.merge(spark.createDataFrame([(k, 0, "old") for k in range(10)], "k BIGINT, t INT, v STRING"))
    table.merge(spark.createDataFrame([(k, 1, "new") for k in range(10)], BASE))
    assert rows_of(table.read(spark), "v") == [("new",)] * 10


def test_a_change_of_the_same_age_beats_the_base_row(spark, folder):
    """Batch and stream agree on ties, deletions included, and a batch again changes nothing."""
    base = spark.range(40).selectExpr("id AS k", "1 AS t", "'base' AS v")
    changes = spark.range(20).selectExpr("id AS k", "1 AS t", "'new' AS v", "IF(id % 2 = 0, 'D', 'U') AS change_op")
    expected = rows_of(apply_changes(base, changes, ["k"], ["t"]))
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=4)
    table.merge(base.withColumn("change_op", F.lit(None).cast("string")))
    for _ in range(2):
        table.merge(changes)
        assert rows_of(table.read(spark), "k", "t", "v") == expected
    assert len(expected) == 30


def test_a_bucket_is_written_by_several_tasks_and_moved_into_place(spark, folder, monkeypatch):
    """One bucket is no longer one task, and what is written aside is not written again."""
    remove = Folder.remove
    monkeypatch.setattr(Folder, "remove", lambda self: None if self.path.endswith("__staging") else remove(self))
    rows = spark.range(2000).selectExpr("id AS k", "0 AS t", "repeat(uuid(), 20) AS v")
    table = CurrentTable(f"{folder}/t", ("k",), ("t",), buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.merge(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(Folder(spark, f"{folder}/t/key_buckets=1/key_bucket=0").names()) > 1
    assert Folder(spark, f"{folder}/t__staging").partition_values("key_bucket") == []
    assert table.read(spark).count() == 2000
