from __future__ import annotations

import json

import pytest

from panelcast.plans import tables as T
from panelcast.session import scratch_dir
from panelcast.sources import landed, landing
from panelcast.sources.feed_source import WEEK_MS, read_weekly_feed


@pytest.fixture(scope="module")
def feed(spark, sf_dir):
    path, index = scratch_dir(spark, "feed"), scratch_dir(spark, "index")
    landing.land_feed(T.hourly_grid(spark, sf_dir), path, index)
    return path, index


def rows(df):
    return sorted((tuple(r) for r in df.select("series_id", "epoch_ms", "y").collect()), key=repr)


def test_equals_the_plain_reader(spark, feed):
    assert rows(read_weekly_feed(spark, *feed)) == rows(landed.read_feed(spark, *feed))


def test_bounds_read_only_the_shards_they_need(spark, feed):
    whole = read_weekly_feed(spark, *feed)
    stamps = sorted(r[0] for r in whole.select("week_stamp").distinct().collect())
    assert whole.rdd.getNumPartitions() == len(stamps) > 3
    low, high = stamps[1] + 5, stamps[2] + 7
    for bounds, shards in (
        ((low, high), 2),
        ((stamps[2] + WEEK_MS, None), len(stamps) - 3),
        ((stamps[1], stamps[2]), 1),
        ((None, stamps[0]), 0),
    ):
        part = read_weekly_feed(spark, *feed, start_ms=bounds[0], end_ms=bounds[1])
        # without shards Spark asks for one empty partition
        assert part.rdd.getNumPartitions() == max(shards, 1)
        a, b = bounds[0] or 0, bounds[1] or 1 << 60
        assert rows(part) == [r for r in rows(whole) if a <= r[1] < b]
    # filters are Spark's own, and one frame serves many queries
    assert rows(whole.filter(f"epoch_ms < {low}")) == [r for r in rows(whole) if r[1] < low]


def test_skipped_years(spark, sf_dir):
    path, index = scratch_dir(spark, "feed"), scratch_dir(spark, "index")
    landing.land_feed(T.daily(spark, sf_dir), path, index)
    got = read_weekly_feed(spark, path, index, skip_years=2)
    assert rows(got) == rows(landed.read_feed(spark, path, index, skip_years=2))


def test_bad_bodies_are_named(spark, tmp_path):
    for stamp, lines in ((0, ['{"series_id": "a", "series": [[1, 2.5], [2, null]]}']),
                         (WEEK_MS, ["not json", '{"series_id": "a"}', '{"series_id": "b", "series": [[3, 1]]}'])):
        folder = tmp_path / "feed" / f"week_stamp={stamp}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text("\n".join(lines))
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "i.txt").write_text(json.dumps({"timestamps": [0, WEEK_MS, 2 * WEEK_MS]}))
    path, index = str(tmp_path / "feed"), str(tmp_path / "index")
    with pytest.raises(Exception, match="part.txt, line 1"):
        read_weekly_feed(spark, path, index).collect()
    found = read_weekly_feed(spark, path, index, on_error="report").collect()
    assert sorted((r.series_id, r.epoch_ms, r.y) for r in found if r.error is None) == [
        ("a", 1, 2.5), ("a", 2, None), ("b", 3, 1.0),
    ]
    bad = sorted(r.error for r in found if r.error)
    assert len(bad) == 2 and "line 1: JSONDecodeError" in bad[0] and "line 2: KeyError" in bad[1]
    # the bad shard is not opened where the bounds do not need it
    assert read_weekly_feed(spark, path, index, end_ms=WEEK_MS).count() == 2
    with pytest.raises(Exception, match="onError"):
        read_weekly_feed(spark, path, index, on_error="ignore").collect()
