"""Wire bodies made from events stay under the frame limit at every size."""

import pytest
from pyspark.sql import functions as F

from loglake.plans import registry
from loglake.sources import wire

BIG = "/root/testdata/sf0.1"


@pytest.fixture(params=["many events", "copies of one event"])
def folder(request, spark, tmp_path):
    if request.param == "many events":
        return BIG
    one = spark.read.parquet(f"{BIG}/events.parquet").limit(1)
    one.crossJoin(spark.range(20_000)).drop("id").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_no_body_passes_the_frame_limit(spark, monkeypatch, folder):
    monkeypatch.setattr(wire, "NATIVE_LIMIT", 128 << 10)  # a small limit instead of millions of events
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    assert registry.queries()["native_decode"](spark, folder).count() == rows


def test_requests_hold_few_records(spark, folder):
    sizes = registry._bodies(spark, folder, F.col("message")).groupBy("request").count()
    assert sizes.agg(F.max("count")).first()[0] <= 500
