import os
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException

from conftest import rows_of
from tributary import names, schemas
from tributary.sinks import audit
from tributary.sinks.audit import read_files_ledger, read_log, rejected_files
from tributary.sources.tables import read_appended
from tributary.streaming import arrivals
from tributary.streaming.arrivals import batch_loader, ingest_arrivals


class Drop:
    """A folder that files arrive in, and the warehouse they are loaded into."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.inbox, self.root, self.archive = f"{folder}/inbox", f"{folder}/wh", f"{folder}/processed"
        os.makedirs(self.inbox)

    def put(self, name, text):
        with open(f"{self.inbox}/{name}", "w", encoding="latin-1", newline="") as file:
            file.write(text)

    def run(self, **options):
        ingest_arrivals(
            self.spark, self.inbox, self.root, f"{self.folder}/checkpoint", archive=self.archive, **options
        ).awaitTermination()

    def raw(self, table):
        return read_appended(self.spark, names.raw_path(self.root, table))

    def log(self):
        return rows_of(read_log(self.spark, self.root), "BQ_TABLE_NAME", "RECORDS_INSERTED", "STATUS")

    def names_in(self, folder):
        return sorted(name for _, _, found in os.walk(folder) for name in found if not name.endswith(".crc"))

    def archived(self):
        return self.names_in(self.archive)

    def load_batch(self, batch_id, files, **options):
        """One micro-batch of these files, as the stream calls it."""
        paths = [(f"file:{self.inbox}/{name}", 0) for name in files]
        load = batch_loader(self.spark, self.root, "s", archive=self.archive, quarantine=f"{self.folder}/bad", **options)
        load(self.spark.createDataFrame(paths, "path string, length bigint"), batch_id)

    def state(self):
        """What the warehouse and the folders hold."""
        ledger = rows_of(read_files_ledger(self.spark, self.root), "PATH", "STATUS", "RECORDS_INSERTED", "MOVED_TO")
        return rows_of(self.raw("ads"), "ad_id"), self.log(), ledger, self.archived(), self.names_in(f"{self.folder}/bad")


@pytest.fixture
def drop(spark, folder):
    return Drop(spark, folder)


ADS = "ad_id,campaign_id,creative_type,headline,created_at\n"
CONVERSIONS = "conversion_id,customer_id,campaign_id,conversion_time,conversion_type,revenue\n"


def test_files_go_to_their_tables_once(drop):
    drop.put("Ads.1.csv", ADS + "71,1,Poster,caf\xe9,2025-02-08 06:15:00\n72,3,Leaflet,NA,2025-05-20 18:00:00\n")
    drop.put(" CONVERSIONS .csv", CONVERSIONS + "701,9,1,2025-02-12 12:00:00,Order,49.95\n")
    drop.run()
    drop.run()
    assert rows_of(drop.raw("ads"), "ad_id", "headline") == [(71, "caf\xe9"), (72, None)]
    assert rows_of(drop.raw("conversions"), "conversion_id", "revenue") == [(701, Decimal("49.95"))]
    assert drop.log() == [("ads", 2, "succeeded"), ("conversions", 1, "succeeded")]


def test_load_time_replaces_the_files_created_at(drop, spark):
    drop.put("ads.csv", ADS + "71,1,Poster,x,1999-01-01 00:00:00\n")
    drop.run()
    raw = drop.raw("ads")
    assert raw.columns == [*schemas.columns(schemas.SOURCE["ads"]), "modified_at"]
    assert raw.schema["created_at"].dataType.simpleString() == "timestamp"
    assert raw.filter("created_at = modified_at AND created_at > timestamp'2020-01-01'").count() == 1


def test_a_later_file_is_appended_and_loaded_files_are_archived(drop):
    drop.put("ads.1.csv", ADS + "71,1,Poster,old,2025-02-08 06:15:00\n")
    drop.run()
    drop.put("ads.2.csv", ADS + "71,1,Poster,new,2025-02-08 06:15:00\n")
    drop.run()
    assert rows_of(drop.raw("ads"), "headline") == [("new",), ("old",)]
    assert drop.archived() == ["ads.1.csv", "ads.2.csv"] and os.listdir(drop.inbox) == []
    drop.put("ads.3.csv", ADS + "73,1,Poster,third,2025-02-08 06:15:00\n")
    drop.run()
    assert drop.archived() == ["ads.1.csv", "ads.2.csv", "ads.3.csv"]
    assert drop.raw("ads").count() == 3


def test_many_small_batches_load_everything_once(drop):
    for i in range(5):
        drop.put(f"ads.{i}.csv", ADS + f"{i},1,Poster,x,2025-02-08 06:15:00\n")
    drop.run(files_per_batch=2)
    assert rows_of(drop.raw("ads"), "ad_id") == [(i,) for i in range(5)]
    assert drop.log() == [("ads", 1, "succeeded")] * 5


def test_an_undeclared_feed_gets_its_own_table(drop, spark):
    drop.put("Proposals.2026.csv", "Application Id/Proposer number,amount\n007,12\n")
    drop.run()
    raw = drop.raw("proposals")
    assert raw.columns == ["Application Id", "amount", "created_at", "modified_at"]
    assert rows_of(raw, "Application Id", "amount") == [("007", "12")]


def test_a_bad_file_stops_the_stream_after_the_other_feeds(drop):
    drop.put("ads.csv", ADS + "many,1,Poster,x,2025-02-08 06:15:00\n")
    drop.put("conversions.csv", CONVERSIONS + "701,9,1,2025-02-12 12:00:00,Order,49.95\n")
    with pytest.raises(StreamingQueryException, match="ads"):
        drop.run()
    assert drop.log() == [("ads", None, "failed"), ("conversions", 1, "succeeded")]
    # Mended in place, the batch is run again: the good feed is not loaded twice.
    drop.put("ads.csv", ADS + "71,1,Poster,x,2025-02-08 06:15:00\n")
    drop.run()
    assert drop.log() == [("ads", 1, "succeeded"), ("conversions", 1, "succeeded")]
    assert drop.raw("conversions").count() == 1 and drop.raw("ads").count() == 1


def test_a_bad_file_can_be_logged_and_passed_over(drop, spark):
    drop.put("ads.csv", ADS + "many,1,Poster,x,2025-02-08 06:15:00\n")
    drop.run(on_failure="log")
    drop.put("clicks.csv", "click_id,ad_id,customer_id,click_time,device_type\n1,2,3,2026-01-01 00:00:00,web\n")
    drop.run(on_failure="log")
    assert drop.log() == [("ads", None, "failed"), ("clicks", 1, "succeeded")]
    error = read_log(spark, drop.root).filter("STATUS = 'failed'").first()["ERROR"]
    assert error == "ad_id is no int: many"


def test_file_names_with_pattern_characters_are_taken_literally(drop):
    drop.put("ads.[1].{a,b}*.csv", ADS + "71,1,Poster,x,2025-02-08 06:15:00\n")
    drop.put("ads.1.a.csv", ADS + "72,1,Poster,y,2025-02-08 06:15:00\n")
    drop.run(files_per_batch=1)
    assert rows_of(drop.raw("ads"), "ad_id") == [(71,), (72,)]


def test_files_of_any_size_are_discovered_without_reading_them(drop, spark):
    limit = "spark.sql.sources.binaryFile.maxLength"
    drop.put("ads.csv", ADS + "71,1,Poster,x,2025-02-08 06:15:00\n")
    try:
        spark.conf.set(limit, 8)  # reading a longer file's content is an error
        drop.run()
    finally:
        spark.conf.unset(limit)
    assert drop.raw("ads").count() == 1


def test_line_ends_in_cells_and_blank_lines(drop):
    lines = "".join(f'{i},1,Poster,"no ""{i}"", or",2025-02-08 06:15:00\n' for i in range(300))
    drop.put("ads.1.csv", ADS + lines)
    drop.put("ads.2.csv", ADS + '300,1,Poster,"two\nlines",2025-02-08 06:15:00\n')
    drop.put("ads.3.csv", ADS + '\n   \n301,1,Poster,x,2025-02-08 06:15:00\n \t\n\n302,1,Poster,"y\nz",2025-02-08 06:15:00\n')
    drop.put("ads.4.csv", ADS + '303,1,Poster,w,2025-02-08 06:15:00\n   \n\n')
    drop.run()
    headlines = dict(rows_of(drop.raw("ads"), "ad_id", "headline"))
    assert headlines == {i: f'no "{i}", or' for i in range(300)} | {300: "two\nlines", 301: "x", 302: "y\nz", 303: "w"}


def test_files_stay_in_the_file_drop_under_legal_names(drop):
    drop.put("customers.csv", "customer_id\n7\n")
    drop.put("my-feed.csv", "a,b\n1,2\n")
    drop.put(" .csv", "a\n1\n")
    drop.run(on_failure="log")
    found = {table: status for table, _, status in drop.log()}
    assert found == {"customers": "succeeded", "my_feed": "succeeded", "": "failed"}
    assert rows_of(drop.raw("my_feed"), "a", "b") == [("1", "2")]


def test_columns_are_matched_by_name(drop):
    drop.put("clicks.1.csv", "click_id,ad_id,customer_id,click_time,device_type\n1,2,3,2026-01-01 00:00:00,web\n")
    drop.put("clicks.2.csv", "device_type,customer_id,click_id\nios,30,10\n")
    drop.run()
    assert rows_of(drop.raw("clicks"), "click_id", "ad_id", "customer_id", "device_type") == [
        (1, 2, 3, "web"), (10, None, 30, "ios"),
    ]
    assert drop.raw("clicks").columns == [*schemas.columns(schemas.SOURCE["clicks"]), "created_at", "modified_at"]


def test_a_declared_feed_takes_no_other_columns(drop):
    drop.put("clicks.csv", "click_id,colour\n1,red\n")
    drop.run(on_failure="log")
    assert drop.log() == [("clicks", None, "failed")]


def test_an_empty_file_is_passed_over(drop):
    drop.put("clicks.csv", "")
    drop.put("ads.csv", ADS + "71,1,Poster,x,2025-02-08 06:15:00\n")
    drop.run()
    assert drop.log() == [("ads", 1, "succeeded")]


def test_undeclared_files_may_differ_in_their_columns(drop):
    drop.put("proposals.1.csv", "id,amount\n1,5\n")
    drop.put("proposals.2.csv", "id,note\n2,late\n")
    drop.run()
    assert rows_of(drop.raw("proposals"), "id", "amount", "note") == [("1", "5", None), ("2", None, "late")]


def test_a_stream_can_keep_going(drop, spark):
    query = ingest_arrivals(
        spark, drop.inbox, drop.root, f"{drop.folder}/checkpoint", every="100 milliseconds"
    )
    try:
        for i in range(2):
            drop.put(f"ads.{i}.csv", ADS + f"{i},1,Poster,x,2025-02-08 06:15:00\n")
            query.processAllAvailable()
            assert drop.raw("ads").count() == i + 1
    finally:
        query.stop()


def good(ad):
    return ADS + f"{ad},1,Poster,x,2025-02-08 06:15:00\n"


def good_bad_good(drop):
    drop.put("ads.1.csv", good(71))
    drop.put("ads.2.csv", good(72) + "many,1,Poster,x,2025-02-08 06:15:00\n")
    drop.put("ads.3.csv", good(73) + "74,1,Poster,y,2025-02-08 06:15:00\n")
    return ["ads.1.csv", "ads.2.csv", "ads.3.csv"]


def expected_state(drop, load_id="s-0"):
    name = lambda k: f"file:{drop.inbox}/ads.{k}.csv"
    return (
        [(71,), (73,), (74,)],
        [("ads", None, "failed"), ("ads", 1, "succeeded"), ("ads", 2, "succeeded")],
        [
            (name(1), "succeeded", 1, f"{drop.archive}/{load_id}/ads.1.csv"),
            (name(2), "failed", None, f"{drop.folder}/bad/{load_id}/ads.2.csv"),
            (name(3), "succeeded", 2, f"{drop.archive}/{load_id}/ads.3.csv"),
        ],
        ["ads.1.csv", "ads.3.csv"],
        ["ads.2.csv"],
    )


def test_a_bad_file_does_not_keep_the_others_of_its_feed_out(drop, spark):
    good_bad_good(drop)
    options = {"on_failure": "log", "quarantine": f"{drop.folder}/bad"}
    drop.run(**options)
    assert drop.state() == expected_state(drop, "arrivals-0")
    assert rows_of(rejected_files(spark, drop.root), "ERROR") == [("ad_id is no int: many",)]
    drop.run(**options)
    assert drop.state() == expected_state(drop, "arrivals-0")


def test_a_batch_that_is_tried_again_changes_nothing(drop):
    files = good_bad_good(drop)
    for _ in range(2):
        drop.load_batch(0, files, on_failure="log")
        assert drop.state() == expected_state(drop)


@pytest.mark.parametrize("where", ["write_logs", "write_files", "_move"])
def test_a_batch_that_broke_off_is_finished(drop, monkeypatch, where):
    """Before the log, between log and ledger, and between ledger and moves."""
    files = good_bad_good(drop)

    def lost(*_):
        raise ConnectionError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(arrivals, where, lost)
        with pytest.raises(ConnectionError):
            drop.load_batch(0, files, on_failure="log")
    assert drop.archived() == []
    drop.load_batch(0, files, on_failure="log")
    assert drop.state() == expected_state(drop)


def test_moves_that_broke_off_half_way_are_finished(drop, monkeypatch):
    files = good_bad_good(drop)
    moved, move_to = [], arrivals.Folder.move_to

    def once(folder, path):
        if moved:
            raise ConnectionError("driver lost")
        moved.append(path)
        move_to(folder, path)

    with monkeypatch.context() as broken:
        broken.setattr(arrivals.Folder, "move_to", once)
        with pytest.raises(ConnectionError):
            drop.load_batch(0, files, on_failure="log")
    assert len(drop.archived()) + len(drop.names_in(f"{drop.folder}/bad")) == 1
    drop.load_batch(0, files, on_failure="log")
    assert drop.state() == expected_state(drop)


def test_nothing_moves_while_a_batch_fails(drop):
    files = good_bad_good(drop)
    with pytest.raises(Exception, match="ad_id is no int: many"):
        drop.load_batch(0, files)
    assert drop.archived() == [] and drop.names_in(drop.inbox) == files
    assert drop.log() == [("ads", None, "failed"), ("ads", 1, "succeeded"), ("ads", 2, "succeeded")]
    drop.put("ads.2.csv", good(72))  # mended
    drop.load_batch(0, files)
    assert rows_of(drop.raw("ads"), "ad_id") == [(71,), (72,), (73,), (74,)]
    assert drop.archived() == files


def test_every_way_a_file_can_be_wrong(drop, spark):
    wrong = {
        "ads.cell.csv": good(1) + "2,x,Poster,x,2025-02-08 06:15:00\n",
        "ads.long.csv": good(1) + "2,1,Poster,x,2025-02-08 06:15:00,more\n",
        "ads.header.csv": "ad_id,colour\n1,red\n",
        "ads.twice.csv": "ad_id,AD_ID\n1,2\n",
        "ads.blank.csv": "\n1,2\n",
        ".": None,
    }
    for name, text in wrong.items():
        if text is not None:
            drop.put(name, text)
    drop.put("ads.good.csv", good(7))
    drop.put("ads.none.csv", ADS)
    drop.put("ads.quoted.csv", ADS + '8,1,Poster,"two\nlines",2025-02-08 06:15:00\n')
    drop.put("ads.odd.csv", ADS + '9,1,Poster,5" wide,2025-02-08 06:15:00\n')
    drop.run(on_failure="log", quarantine=f"{drop.folder}/bad")
    assert drop.names_in(f"{drop.folder}/bad") == sorted(name for name in wrong if name != ".")
    assert rows_of(drop.raw("ads"), "ad_id", "headline") == [(7, "x"), (8, "two\nlines"), (9, '5" wide')]
    ledger = {r["PATH"].rpartition("/")[2]: r for r in read_files_ledger(spark, drop.root).collect()}
    assert ledger["ads.none.csv"]["RECORDS_INSERTED"] == 0 and ledger["ads.none.csv"]["STATUS"] == "succeeded"
    assert "more than 5 cells" in ledger["ads.long.csv"]["ERROR"] and "no columns ['colour']" in ledger["ads.header.csv"]["ERROR"]
    assert "campaign_id is no int: x" == ledger["ads.cell.csv"]["ERROR"]


def test_a_batch_of_bad_files_loads_nothing(drop):
    drop.put("ads.1.csv", ADS + "many,1,Poster,x,2025-02-08 06:15:00\n")
    drop.load_batch(3, ["ads.1.csv"], on_failure="log")
    assert not os.path.exists(names.raw_path(drop.root, "ads")) and drop.names_in(f"{drop.folder}/bad") == ["ads.1.csv"]


def test_one_job_logs_a_batch(drop):
    for k in range(6):
        drop.put(f"ads.{k}.csv", good(k))
    drop.load_batch(0, [f"ads.{k}.csv" for k in range(6)])
    assert len(drop.names_in(names.audit_path(drop.root))) == 1
    assert audit.read_log(drop.spark, drop.root).count() == 6
