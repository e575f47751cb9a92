from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tributary import names, schemas
from tributary.sinks.audit import logged, now, read_log
from tributary.sinks.layers import append_load, publish, replace_snapshot, set_up_layers
from tributary.sources.tables import read_appended, read_raw, read_snapshot
from tributary.storage import CHECKPOINT_SETTING, WAREHOUSE_SETTING, Folder, shared_folder, work_folder

DAY = datetime(2026, 1, 1, 23, tzinfo=timezone.utc)


def numbers(spark, n, v="x"):
    return spark.range(n).withColumn("v", F.lit(v))


def test_a_snapshot_replaces_the_whole_table(spark, folder):
    path = f"{folder}/t"
    assert replace_snapshot(numbers(spark, 10), path, DAY) == 10
    assert replace_snapshot(numbers(spark, 3), path, DAY) == 3
    assert read_snapshot(spark, path).count() == 3
    assert replace_snapshot(numbers(spark, 4), path, DAY + timedelta(days=1)) == 4
    assert Folder(spark, path).partition_values("ingestion_date") == ["2026-01-02"]
    assert read_snapshot(spark, path).columns == ["id", "v"] and read_snapshot(spark, path).count() == 4


def test_writing_a_snapshot_sorts_nothing(spark, folder):
    replace_snapshot(spark.range(10).selectExpr("id", "id + 1 AS v"), f"{folder}/t", DAY)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    (plan,) = [p for p in plans if f"{folder}/t" in p]
    assert "CollectMetrics" in plan and "Sort" not in plan


def test_snapshots_can_be_kept_by_date(spark, folder):
    path = f"{folder}/t"
    replace_snapshot(numbers(spark, 10), path, DAY, keep_history=True)
    replace_snapshot(numbers(spark, 4), path, DAY + timedelta(days=1), keep_history=True)
    assert read_snapshot(spark, path).count() == 4
    assert read_snapshot(spark, path, date="2026-01-01").count() == 10


@pytest.mark.parametrize("keep_history", [False, True])
@pytest.mark.parametrize("later", [timedelta(0), timedelta(days=1)])
def test_an_empty_snapshot_is_empty(spark, folder, keep_history, later):
    path = f"{folder}/t"
    replace_snapshot(numbers(spark, 10), path, DAY, keep_history)
    assert replace_snapshot(numbers(spark, 10).filter("id < 0"), path, DAY + later, keep_history) == 0
    assert read_snapshot(spark, path).count() == 0
    assert read_snapshot(spark, path).columns == ["id", "v"]


def test_a_failing_write_leaves_the_old_snapshot(spark, folder):
    path = f"{folder}/t"
    replace_snapshot(numbers(spark, 10), path, DAY)
    broken = spark.range(100, numPartitions=4).withColumn("v", F.expr("CAST(1 / (id - 99) AS STRING)"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        replace_snapshot(broken, path, DAY)
    assert read_snapshot(spark, path).count() == 10


def test_the_date_is_that_of_the_run_in_utc(spark, folder):
    east = timezone(timedelta(hours=5, minutes=30))
    replace_snapshot(numbers(spark, 1), f"{folder}/t", datetime(2026, 1, 2, 3, tzinfo=east))
    assert Folder(spark, f"{folder}/t").partition_values("ingestion_date") == ["2026-01-01"]


def test_appends_keep_all_versions_and_a_repeated_load_adds_nothing(spark, folder):
    path = f"{folder}/t"
    assert append_load(numbers(spark, 5, "a"), path, "s-0") == 5
    assert append_load(numbers(spark, 5, "b"), path, "s-1") == 5
    append_load(numbers(spark, 5, "c"), path, "s-1")
    assert rows_of(read_appended(spark, path).groupBy("v").count()) == [("a", 5), ("c", 5)]
    assert read_raw(spark, path).columns == ["id", "v"]


@pytest.mark.parametrize("name", ["load_id", "LOAD_ID"])
def test_data_columns_do_not_vanish_under_the_partition_column(spark, folder, name):
    with pytest.raises(ValueError, match="partition column"):
        append_load(spark.range(3).withColumnRenamed("id", name), f"{folder}/t", "s-0")


def test_a_table_that_has_nothing_yet(spark, folder):
    assert read_snapshot(spark, f"{folder}/none", "a INT, b STRING").count() == 0
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, f"{folder}/none")


def drop_layers(spark):
    for row in spark.sql("SHOW DATABASES").collect():
        if row[0] != "default":
            spark.sql(f"DROP DATABASE {row[0]} CASCADE")


def test_raw_tables_appear_with_their_first_load_and_follow_its_columns(spark, folder):
    set_up_layers(spark, folder)
    path = names.raw_path(folder, "ads")
    for load, rows in enumerate([spark.range(3), spark.range(4), numbers(spark, 2)]):
        append_load(rows, path, f"s-{load}")
        publish(spark, "raw_marketing", "ads", path)
        assert spark.table("raw_marketing.ads").count() == [3, 7, 9][load]
    drop_layers(spark)


@pytest.fixture
def shop(spark, folder):
    spark.sql(f"CREATE DATABASE shop LOCATION '{folder}/shop'")
    yield "shop"
    spark.sql("DROP DATABASE shop CASCADE")


def by_name_and_path(spark, path):
    spark.catalog.clearCache()
    return rows_of(spark.table("shop.t").drop("ingestion_date", "load_id")), rows_of(read_raw(spark, path, merge_schema=True))


def test_a_table_follows_its_data_to_another_root(spark, folder, shop):
    old, new = f"{folder}/old/t", f"{folder}/new/t"
    for path, n in ((old, 3), (new, 5), (old, 4)):
        replace_snapshot(numbers(spark, n), path, DAY)
        publish(spark, shop, "t", path, ("ingestion_date", DAY.date()))
        name, place = by_name_and_path(spark, path)
        assert name == place and len(name) == n


def test_a_table_takes_new_columns_and_keeps_old_ones(spark, folder, shop):
    path = f"{folder}/t"
    loads = [spark.range(2), numbers(spark, 3), spark.range(1).withColumnRenamed("id", "Odd `name`, (1)"), numbers(spark, 1).withColumnRenamed("v", "w")]
    for k, rows in enumerate(loads):
        append_load(rows, path, f"a:{k}'s")
        publish(spark, shop, "t", path, ("load_id", f"a:{k}'s"))
    table = spark.table("shop.t")
    assert table.columns == ["id", "v", "Odd `name`, (1)", "w", "load_id"]
    assert rows_of(table.groupBy("load_id").count()) == [("a:0's", 2), ("a:1's", 3), ("a:2's", 1), ("a:3's", 1)]
    assert rows_of(table, "id", "v", "w") == rows_of(read_raw(spark, path, merge_schema=True), "id", "v", "w")


def test_removed_and_replaced_partitions_are_seen_by_name(spark, folder, shop):
    path = f"{folder}/t"
    for days, n in ((0, 3), (1, 4), (1, 6), (2, 0), (3, 2)):
        run = DAY + timedelta(days=days)
        replace_snapshot(numbers(spark, 9).filter(F.col("id") < n), path, run)
        publish(spark, shop, "t", path, ("ingestion_date", run.date()))
        name, place = by_name_and_path(spark, path)
        assert name == place and len(name) == n
        assert spark.sql("SHOW PARTITIONS shop.t").count() == 1
    Folder(spark, f"{path}/ingestion_date={run.date()}").remove()
    replace_snapshot(numbers(spark, 2), path, DAY, keep_history=True)
    publish(spark, shop, "t", path)  # by comparing names
    assert rows_of(spark.table("shop.t"), "ingestion_date") == [(DAY.date(),)] * 2


def test_a_column_of_another_type_makes_the_table_anew(spark, folder, shop):
    path = f"{folder}/t"
    for rows in (spark.range(3), spark.range(3).selectExpr("cast(id as string) id")):
        replace_snapshot(rows, path, DAY)
        publish(spark, shop, "t", path, ("ingestion_date", DAY.date()))
    assert rows_of(spark.table("shop.t"), "id") == [("0",), ("1",), ("2",)]


def test_publishing_neither_repairs_nor_remakes(spark, folder, shop, monkeypatch):
    path, said = f"{folder}/t", []
    append_load(spark.range(2), path, "l-0")
    publish(spark, shop, "t", path, ("load_id", "l-0"))
    append_load(numbers(spark, 2), path, "l-1")
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **b: said.append(text) or sql(self, text, *a, **b))
    publish(spark, shop, "t", path, ("load_id", "l-1"))
    assert [text.split("(")[0].strip() for text in said if text.startswith(("ALTER", "DROP", "MSCK", "CREATE"))] == [
        "ALTER TABLE shop.`t` ADD COLUMNS", "ALTER TABLE shop.`t` ADD IF NOT EXISTS PARTITION",
    ]


def test_setting_up_another_root_moves_all_tables(spark, folder):
    for root in (f"{folder}/one", f"{folder}/two", f"{folder}/one"):
        set_up_layers(spark, root)
        curated = names.curated_path(root, "campaign_summary")
        assert spark.table("curated.campaign_summary").count() == (1 if Folder(spark, curated).exists() else 0)
        replace_snapshot(spark.createDataFrame([(1, root, "b", None, None)], schemas.CURATED["campaign_summary"]), curated, DAY)
        publish(spark, "curated", "campaign_summary", curated)
        assert rows_of(spark.table("curated.campaign_summary"), "campaign_name") == [(root,)]
        raw = names.raw_path(root, "ads")
        append_load(spark.range(3), raw, f"s-{root[-3:]}")
        publish(spark, "raw_marketing", "ads", raw, ("load_id", f"s-{root[-3:]}"))
        assert spark.table("raw_marketing.ads").count() == 3
    set_up_layers(spark, f"{folder}/three")
    assert spark.table("raw_marketing.ads").count() == 0
    drop_layers(spark)


def test_without_the_layers_nothing_is_published(spark, folder):
    append_load(spark.range(3), f"{folder}/t", "s-0")
    publish(spark, "raw_marketing", "ads", f"{folder}/t")
    assert not spark.catalog.databaseExists("raw_marketing")


def test_layers_are_set_up_once_and_see_new_snapshots(spark, folder):
    set_up_layers(spark, folder)
    set_up_layers(spark, folder)
    databases = {row[0] for row in spark.sql("SHOW DATABASES").collect()}
    domains = names.DOMAINS
    assert {f"raw_{d}" for d in domains} | {f"transformed_{d}" for d in domains} | {"curated", "audit"} <= databases
    assert spark.table("curated.campaign_summary").columns == [
        *schemas.columns(schemas.CURATED["campaign_summary"]), "ingestion_date",
    ]
    for entity, domain in names.DOMAIN_OF.items():
        columns = schemas.columns(schemas.TRANSFORMED[entity])
        assert spark.table(f"transformed_{domain}.{entity}").columns == [*columns, "ingestion_date"]

    path = names.curated_path(folder, "campaign_summary")
    rows = spark.createDataFrame([(1, "a", "b", None, None)], schemas.CURATED["campaign_summary"])
    for run in (DAY, DAY + timedelta(days=1)):
        replace_snapshot(rows, path, run)
        publish(spark, "curated", "campaign_summary", path)
        table = spark.table("curated.campaign_summary")
        assert rows_of(table, "campaign_id", "ingestion_date") == [(1, run.date())]
    drop_layers(spark)


def test_the_log_tells_success_and_failure(spark, folder):
    assert logged(spark, folder, "SRC", "raw_customer", "good", "SPARK", lambda started: 7) == 7

    def fails(started):
        raise ValueError("no such host")

    with pytest.raises(ValueError, match="no such host"):
        logged(spark, folder, "SRC", "raw_customer", "bad", "SPARK", fails)
    log = read_log(spark, folder)
    assert log.columns == schemas.columns(schemas.AUDIT)
    assert rows_of(log, "BQ_TABLE_NAME", "RECORDS_INSERTED", "RECORDS_UPDATED", "RECORDS_DELETED", "STATUS", "ERROR") == [
        ("bad", None, None, None, "failed", "no such host"), ("good", 7, None, None, "succeeded", None),
    ]
    assert log.filter("RUN_START_TIME <= RUN_END_TIME AND RUN_END_TIME <= INGESTION_TIME").count() == 2


def test_a_retried_load_has_one_entry(spark, folder):
    for rows in (1, 2):
        logged(spark, folder, "SRC", "raw", "t", "SPARK", lambda started, rows=rows: rows, run_id="stream-0-t")
    assert rows_of(read_log(spark, folder), "RUN_ID", "RECORDS_INSERTED") == [("stream-0-t", 2)]


def test_run_ids_that_look_like_numbers_stay_text(spark, folder):
    for run_id in ("12e5", "0012", "7"):
        logged(spark, folder, "SRC", "raw", "t", "SPARK", lambda started: 1, run_id=run_id)
    assert {row["RUN_ID"] for row in read_log(spark, folder).collect()} == {"12e5", "0012", "7"}


class Session:
    """What a session says of its shared folders."""

    def __init__(self, checkpoints=None, warehouse=None):
        self.settings = {CHECKPOINT_SETTING: checkpoints, WAREHOUSE_SETTING: warehouse}
        self.conf, self.sparkContext = self, self

    def get(self, name, default):
        return self.settings[name] or default

    def getCheckpointDir(self):
        return None


def test_working_folders_are_in_the_folder_the_session_names():
    session = Session("hdfs://shared/checkpoints")
    assert work_folder(session, "a").startswith("hdfs://shared/checkpoints/a-")
    assert work_folder(session, "a") != work_folder(session, "a")


def test_without_one_they_are_in_the_warehouse_and_never_local():
    assert shared_folder(Session(warehouse="hdfs://warehouse")) == "hdfs://warehouse/_work"
    with pytest.raises(ValueError, match="executors share"):
        shared_folder(Session())


def test_the_clock_knows_its_zone():
    assert now().utcoffset() == timedelta(0)


def test_the_file_format_is_a_parameter(spark, folder):
    replace_snapshot(numbers(spark, 5), f"{folder}/s", DAY, file_format="orc")
    append_load(numbers(spark, 5), f"{folder}/a", "s-0", file_format="orc")
    assert read_snapshot(spark, f"{folder}/s", file_format="orc").count() == 5
    assert read_appended(spark, f"{folder}/a", file_format="orc").count() == 5
