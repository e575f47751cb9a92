from tributary.session import SETTINGS, apply_settings, sized_for


def test_settings_hold_on_a_running_session(spark):
    apply_settings(spark)
    assert {name: spark.conf.get(name) for name in SETTINGS} == SETTINGS


def test_partitions_follow_the_shuffled_size():
    gib, tib = 2**30, 2**40

    def partitions(size, cores):
        return int(sized_for(size, cores)["spark.sql.shuffle.partitions"])

    assert partitions(0, 8) == 16
    assert partitions(100 * gib, 8) == 400
    assert partitions(10 * tib, 4000) == 40_960
    assert partitions(100 * tib, 4000) == 409_600
    assert partitions(tib, 40_000) == 80_000
