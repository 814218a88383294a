"""Live folds: neither the triggers nor the order of the files change a result."""

import random

import pytest

from lapforge.streaming import live

GATE = (5.0, -20.0, 5.0, 20.0)
SCHEMA = "key string, t_us long, t double, event_id long, e double, n double, speed double"
START = 1_700_000_000_000_000


def rows():
    """Three vehicles that swing across the gate, one row a second."""
    out = []
    for k in range(3):
        out += [(f"v{k}", START + i * 1_000_000, float(i), 1000 * k + i, float((i + k) % 10), 0.0, 9.0) for i in range(40 + k)]
    return out


def brute(data):
    got = []
    for key in sorted({r[0] for r in data}):
        own, lap, last = sorted((r for r in data if r[0] == key), key=lambda r: r[1]), 0, None
        for a, b in zip(own, own[1:]):
            if a[4] == b[4] or not 0 <= (5.0 - a[4]) / (b[4] - a[4]) <= 1:
                continue
            tc = a[2] + (5.0 - a[4]) / (b[4] - a[4]) * (b[2] - a[2])
            if last is None or tc - last > 3.0:
                lap, last = lap + 1, tc
                got.append((key, a[3], round(tc, 6), 1 if b[4] < a[4] else -1, lap))
    return got


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, path, files, delay, idle_us=None):
    """Laps of a stream that sees one file a trigger; a last file lets the watermark pass."""
    end = [("end", START + 10**12, None, None, None, None, None)]
    for i, part in enumerate([*files, end]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    laps = live.live_laps(stream, "key", "t_us", delay, GATE, 3.0, idle_us=idle_us)
    late = live.drain(laps, f"{path}/out")
    got = spark.read.schema(laps.schema).parquet(f"{path}/out").collect()
    return late, sorted((r["key"], r["event_id"], round(r["t_cross"], 6), r["side"], r["lap_no"]) for r in got)


def test_shuffled_files_equal_one(spark, two_partitions, tmp_path):
    data = rows()
    files = [[r for r in data if (r[1] - START) // 1_000_000 // 11 == i] for i in range(4)]
    random.Random(3).shuffle(files)
    late, got = run(spark, tmp_path / "many", files, "60 seconds")
    assert (late, got) == (0, brute(data))
    late, got = run(spark, tmp_path / "one", [data], "60 seconds")
    assert (late, got) == (0, brute(data))


def test_late_rows_are_counted(spark, two_partitions, tmp_path):
    data = rows()
    first, then, rest = [r for r in data if 12 <= r[2] < 30], [r for r in data if r[2] >= 30], [r for r in data if r[2] < 12]
    late, got = run(spark, tmp_path, [first, then, rest], "2 seconds")
    assert late == len(rest) and got == brute(first + then)


def test_idle_vehicles_are_forgotten(spark, two_partitions, tmp_path):
    data = [r for r in rows() if r[0] == "v0"]
    later = [(k, u + 3_600_000_000, t + 3600, i + 500, e, n, s) for k, u, t, i, e, n, s in data]
    _, got = run(spark, tmp_path, [data, later], "5 seconds", idle_us=600_000_000)
    assert got == sorted(brute(data) + [(k, i, round(t, 6), s, lap) for k, i, t, s, lap in brute(later)])
