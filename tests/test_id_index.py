"""The id index of the streams."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from pulso.streaming import posts as ST
from pulso.streaming.id_index import IdIndex

SCHEMA = "id string, createdAt timestamp, score_positive double, score_negative double, score_neutral double"


def posts(spark, ids, day=1):
    at = dt.datetime(2024, 1, day, 12)
    return spark.createDataFrame([(i, at, 0.5, 0.25, 0.25) for i in ids], SCHEMA)


def stored(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_late_duplicates_are_found_in_any_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = ST.indexed_dedup_sink(out, IdIndex(spark, str(tmp_path / "ids"), buckets=8))
    sink(posts(spark, ["a", "b", "a", "c"]), 0)
    for n in range(1, 6):
        sink(posts(spark, [f"x{n}", "b" if n % 2 else "c"], day=n), n)
    sink(posts(spark, ["a", "new"], day=30), 6)
    assert stored(spark, out) == ["a", "b", "c", "new", "x1", "x2", "x3", "x4", "x5"]


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=64)
    index.add(posts(spark, [f"p{i}" for i in range(500)]), "old")
    batch = posts(spark, ["p7", "q"])
    mine = {r[0] for r in batch.select(index.bucket()).collect()}
    found = index.stored(batch, "now")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN ", plan)
    read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= mine
    assert [r.id for r in index.unseen(batch, "now").collect()] == ["q"]


def test_a_batch_that_is_handed_over_again(spark, tmp_path):
    out, ids = str(tmp_path / "out"), str(tmp_path / "ids")
    index = IdIndex(spark, ids, buckets=4)
    sink = ST.indexed_dedup_sink(out, index)
    sink(posts(spark, ["a", "b"]), 0)
    # died after the index was written, before the posts were
    index.add(posts(spark, ["c"]), "direct-1")
    sink(posts(spark, ["b", "c"]), 1)
    sink(posts(spark, ["b", "c"]), 1)
    assert stored(spark, out) == ["a", "b", "c"]
    index.compact()
    sink(posts(spark, ["a", "c", "d"]), 2)
    assert stored(spark, out) == ["a", "b", "c", "d"]
    folders = [d for d, _, _ in os.walk(ids) if "batch=direct-0" in d or "batch=direct-1" in d]
    assert not folders


def test_days_of_late_posts_are_recomputed_once(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    sink = ST.indexed_upsert_days_sink(raw, out, IdIndex(spark, str(tmp_path / "ids"), buckets=4))
    sink(posts(spark, ["a", "b"], 1), 0)
    sink(posts(spark, ["c"], 2), 1)
    for _ in range(2):                                      # late post, replayed, beside a duplicate
        sink(posts(spark, ["late", "a"], 1), 2)
    got = {str(r.date): r.n_posts for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 1}


@pytest.mark.parametrize("null_ids", [1, 2])
def test_null_ids_are_equal(spark, tmp_path, null_ids):
    sink = ST.indexed_dedup_sink(str(tmp_path / "out"), IdIndex(spark, str(tmp_path / "ids"), buckets=4))
    for n in range(null_ids):
        sink(posts(spark, [None, "a"]), n)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_restarted_stream_keeps_its_batch_names(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path)
    index = IdIndex(spark, f"{base}/ids", buckets=4)
    for n, ids in enumerate((["a", "b"], ["b", "c"], ["c", "d", "a"])):
        posts(spark, ids).coalesce(1).write.mode("append").parquet(src)
        q = ST.read_stream(spark, src, posts(spark, ids).schema)
        ST.run_available_now(q, f"{base}/ckpt", foreach_batch=ST.indexed_dedup_sink(f"{base}/out", index))
    assert stored(spark, f"{base}/out") == ["a", "b", "c", "d"]
    names = {r[0] for r in spark.read.parquet(f"{base}/out").select("_batch").distinct().collect()}
    assert len(names) == 3 and len({n.rsplit("-", 1)[0] for n in names}) == 1 and "direct" not in str(names)
