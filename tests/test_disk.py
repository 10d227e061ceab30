"""What loads leave on disk: compressed text, no staged rows, no shuffles."""

import glob
import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lateline.plans import queries
from lateline.plans.ingestion import ingest_tickets
from lateline.sources import staging, star
from lateline.sources.lake import Lake
from lateline.streaming import silver

AS_OF = "2024-04-01T00:00:00Z"


@pytest.fixture
def shop(spark, tmp_path):
    """60 orders of two segments and of none."""
    when, folder = datetime(1998, 2, 6), str(tmp_path / "shop")
    orders = [(n, n % 7, "FPO"[n % 3], 10.0 * n, when, "2-HIGH") for n in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    customers = [(n, ("BUILDING", "MACHINERY", None)[n % 3]) for n in range(7)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_landed_pages_are_compressed_and_whole(spark, shop, monkeypatch):
    monkeypatch.setattr(queries, "PAGES_A_FILE", 20)
    pages = star.raw_issue_pages(spark, shop)
    path = queries._landed(pages)
    files = glob.glob(f"{path}/part-*")
    assert len(files) >= 3 and all(name.endswith(".txt.gz") for name in files)
    assert sorted(spark.read.text(path).collect()) == sorted(pages.collect())
    sets = queries._landed_sets(spark, shop)
    files = glob.glob(f"{sets}/project=*/part-*")
    assert len(files) >= 3 and all(name.endswith(".txt.gz") for name in files)
    assert spark.read.text(sets).count() == star.issue_page_sets(spark, shop).count()


def test_page_sets_number_orders(spark, shop):
    """Rows are numbered before they carry an issue; pages hold each project's issues in the order of their keys."""
    sets = star.issue_page_sets(spark, shop)
    windows = [line for line in sets._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 2
    below = sets._jdf.queryExecution().optimizedPlan().toString().split(windows[-1])[1]
    assert "customfield" not in below and "Ask buyer" not in below
    whole = [json.loads(row["value"]) for row in sets.where("project = 'MACHINERY'").collect()]
    got = {page["startAt"] + i: int(issue["id"]) for page in whole for i, issue in enumerate(sorted(page["issues"], key=lambda issue: int(issue["id"])))}
    assert [got[place] for place in sorted(got)] == [n for n in range(60) if n % 7 in (1, 4)]
    assert {page["total"] for page in whole} == {len(got)}


def test_bronze_is_compressed_and_staged_rows_go(spark, tickets, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    before = set(glob.glob(f"{staging._application_dir(spark).removeprefix('file:')}/fresh-*"))
    summary = ingest_tickets(lake, tickets, AS_OF, run_id="run-1")
    files = glob.glob(f"{tmp_path}/lake/bronze_runs/jira/run=run-1/*/*/part-*")
    assert files and all(name.endswith(".json.gz") for name in files)
    assert lake.read_bronze("jira", tickets.schema).select(*tickets.columns).exceptAll(tickets).isEmpty()
    assert lake.read_bronze("jira", tickets.schema).count() == tickets.count()
    assert set(glob.glob(f"{staging._application_dir(spark).removeprefix('file:')}/fresh-*")) <= before
    assert sum(row["tickets_ingested"] for row in summary.collect()) == tickets.count()


def test_a_staged_table_goes_with_its_block(spark):
    with pytest.raises(ZeroDivisionError), staging.settled(spark.range(5), "brief") as table:
        assert table.count() == 5
        folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
        1 / 0
    assert not os.path.exists(folder)


def test_writes_keep_the_session_as_it_was(spark):
    """Writes that overlap leave the setting as they found it; a frame used again after one is computed again."""
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first = sorted(rows.collect())
    for was in ("false", "true"):
        spark.conf.set(staging._CLEANUP, was)
        with ThreadPoolExecutor(4) as pool:
            tables = list(pool.map(lambda n: staging.settle(rows.where(F.col("k") >= n)), range(8)))
        assert spark.conf.get(staging._CLEANUP) == was
        assert [table.count() for table in tables] == [7, 6, 5, 4, 3, 2, 1, 0]
    spark.conf.unset(staging._CLEANUP)
    assert sorted(rows.collect()) == first


def test_shuffles_of_a_write_go_with_it(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        found = blocks.getAllBlocks()
        return {name for name in (found.apply(i).toString() for i in range(found.size())) if name.startswith("shuffle_")}

    before = held()
    table = staging.settle(spark.range(1000).repartition(3, "id"), "shuffled")
    until = time.time() + 10
    while held() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert not held() - before
    assert table.count() == 1000


def test_a_batch_of_the_stream_is_not_kept_in_memory(spark, shop, tmp_path, monkeypatch):
    lake, kept, write = Lake(spark, str(tmp_path / "lake")), [], Lake.write_bronze
    batch = star.raw_issue_pages(spark, shop).select(F.lit("/project=A/x").alias("file"), "value").unionByName(spark.createDataFrame([("/project=A/x", "{")], "file string, value string"))
    monkeypatch.setattr(Lake, "write_bronze", lambda *a, **b: kept.append(batch.storageLevel.useMemory) or write(*a, **b))
    store = silver.page_batch(lake, star.POINTS_FIELD, star.SPRINT_FIELD, AS_OF)
    for _ in range(2):
        store(batch, 3)
    assert kept == [False] * 4
    assert lake.read_silver("jira").count() == spark.read.json(f"{tmp_path}/lake/bronze_runs/jira").count() == 60
    assert spark.read.json(f"{tmp_path}/lake/bronze_runs/jira_rejects").count() == 1
