"""Streams over several files: late events, increments, the growing index."""

import datetime
import os

from skeinflow.streaming.jobs import hourly_counts, index_stream
from tests.conftest import rows

DAY = datetime.datetime(2024, 1, 1)


def stream(spark, folder, parts, schema):
    """A folder of one file for each part, in their order."""
    folder.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder.parent / f"part{i}"))
        made = next((folder.parent / f"part{i}").glob("*.parquet"))
        made.rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda hours: DAY + datetime.timedelta(hours=hours)
    parts = [
        [(at(0.1), "a", 1.0), (at(0.2), "a", 2.0), (at(30), "a", 4.0)],
        [(at(29.5), "b", 8.0), (at(30.2), "a", 16.0)],  # half an hour late: counted
        [(at(0.3), "a", 32.0), (at(31), "b", 64.0)],  # more than a day late: left out
    ]
    path = stream(spark, tmp_path / "events", parts, "ts timestamp, event_type string, value double")
    into = str(tmp_path / "out")
    got = rows(hourly_counts(spark, path, late="6 hours", into=into, files=1))
    assert got == [(at(0), "a", 2, 3.0), (at(29), "b", 1, 8.0), (at(30), "a", 2, 20.0), (at(31), "b", 1, 64.0)]
    assert len([x for x in os.listdir(into) if x.startswith("increment=")]) >= 3


def test_index_grows_by_increments(spark, tmp_path):
    parts = [
        [(1, "http://a.example/1", "cat dog", 1), (2, "http://a.example/2", "cow", 1)],
        [(3, "http://a.example/1", "cat", 2), (4, "http://a.example/3", None, 2)],
    ]
    path = stream(spark, tmp_path / "crawl", parts, "page_id long, url string, page string, fetched_at long")
    got = {(r["term"], r["url"]) for r in index_stream(spark, path, into=str(tmp_path / "index"), files=1).where("term in ('cat', 'dog', 'cow')").collect()}
    assert got == {("cat", "http://a.example/1"), ("cow", "http://a.example/2")}
