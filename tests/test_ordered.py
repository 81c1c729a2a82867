"""Places over several partitions equal those of one sort."""

import random


def test_places(spark):
    from groundwire.runtime import ordered

    r = random.Random(6)
    rows = [(r.randrange(300), r.randrange(5)) for _ in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered(spark.createDataFrame(rows, "a int, b int").repartition(3), ["a", "b"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(q.a, q.b) for q in sorted(got, key=lambda q: q.place)] == sorted(rows)
    assert sorted(q.place for q in got) == list(range(1, len(rows) + 1))
    assert ordered(spark.createDataFrame([], "a int"), ["a"]).count() == 0
