"""Page sets, united schemas, repeatable runs and marks of loads that overlap."""

import json
import random

import pytest
from conftest import AS_OF, ticket
from pyspark.sql import types as T

from lateline import fixed_values as fv
from lateline.operators import completeness as C
from lateline.operators import incremental as I
from lateline.plans.ingestion import ingest_issue_pages, ingest_messages, ingest_tickets, read_rejects
from lateline.schemas import STATE, TICKET
from lateline.sources.catalog import register_table
from lateline.sources.lake import Lake
from lateline.sources.pages import issue_page_places, page_texts
from lateline.sources.schema_union import SchemaConflict, union_of
from lateline.streaming.silver import page_batch, stream_pages

PAGES = "page_set string, project_key string, start long, n long, total long, rejected boolean"


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def plain_sets(pages):
    """Per set: covered positions by a set of integers, and the runs of those that are missing."""
    out, gaps = {}, []
    for name in {p[0] for p in pages}:
        mine = [p for p in pages if p[0] == name]
        good = [(p[2] or 0, (p[2] or 0) + p[3]) for p in mine if not p[5] and p[3]]
        seen = {i for s, e in good for i in range(s, e)}
        declared = max([p[4] for p in mine if not p[5] and p[4] is not None], default=0)
        total = max([declared, *(e for _, e in good)], default=0)
        lost = sorted(set(range(total)) - seen)
        for i in lost:
            if i - 1 not in lost:
                end = i
                while end in lost:
                    end += 1
                gaps.append((name, i, end))
        rejects = sum(p[5] for p in mine)
        received = sum(e - s for s, e in good)
        out[name] = (len(mine), rejects, total, received, received - len(seen), len(lost), not lost and not rejects)
    return out, sorted(gaps, key=str)


@pytest.mark.parametrize("slice_size", [4, 1 << 20])
def test_page_sets_against_plain_sets(spark, slice_size):
    rng = random.Random(4)
    pages = []
    for name in ("a", "b", "c", None):
        for _ in range(40):
            pages.append((name, "P", rng.choice([None, *range(0, 90, 3)]), rng.randint(0, 7), rng.choice([None, 80, 95]), rng.random() < 0.1))
    pages += [("only rejects", None, None, 0, None, True), ("empty", "E", 0, 0, 0, False), ("nothing came", "N", 0, 0, 12, False), ("whole", "W", 0, 10, 20, False), ("whole", "W", 10, 10, 20, False)]
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    want, gaps = plain_sets(pages)
    names = ("pages", "rejects", "total", "received", "repeated", "missing", "complete")
    got = {r["page_set"]: tuple(r[n] for n in names) for r in C.page_sets(df, slice_size).collect()}
    assert got == want
    assert sorted(((r["page_set"], r["gap_start"], r["gap_end"]) for r in C.page_gaps(df, slice_size).collect()), key=str) == gaps


def test_no_pages(spark):
    df = spark.createDataFrame([], PAGES)
    assert C.page_sets(df).count() == 0 and C.page_gaps(df).count() == 0


def land(folder, start, total, keys, cut=False):
    folder.mkdir(parents=True, exist_ok=True)
    issues = [{"id": k.split("-")[1], "key": k, "fields": {"project": {"key": k.split("-")[0]}, "updated": "2024-03-01T00:00:00Z"}} for k in keys]
    text = json.dumps({"startAt": start, "total": total, "issues": issues})
    (folder / f"{start}.json").write_text(text[: len(text) // 2] if cut else text)


def test_a_lost_page_is_an_error_and_its_mark_stays(spark, lake, tmp_path):
    pages = tmp_path / "pages"
    land(pages / "project=WHOLE", 0, 2, ["WHOLE-1", "WHOLE-2"])
    land(pages / "project=GAP", 0, 3, ["GAP-1"])
    land(pages / "project=CUT", 0, 2, ["CUT-1"])
    land(pages / "project=CUT", 1, 2, ["CUT-2"], cut=True)
    asked = spark.createDataFrame([("IDLE",)], "project_key string")
    for _ in range(2):  # a repeated run changes nothing
        summary, sets = ingest_issue_pages(lake, str(pages), "points", "sprint", AS_OF, run_id="r1", asked=asked)
        outcome = {r["project_key"]: (r["status"], r["tickets_ingested"]) for r in summary.collect()}
        assert outcome == {"WHOLE": ("success", 2), "GAP": ("error", 1), "CUT": ("error", 1), "IDLE": ("no_new_data", 0)}
        assert {r["project_key"]: (r["missing"], r["rejects"]) for r in sets.collect()} == {"WHOLE": (0, 0), "GAP": (2, 0), "CUT": (1, 1)}
        assert [(r["project_key"], r["reason"], "CUT-2"[:3] in r["raw"]) for r in read_rejects(lake).collect()] == [("CUT", "unreadable page", True)]
        assert [r["project_key"] for r in lake.load_state().collect()] == ["WHOLE"]
        assert lake.read_silver("jira").count() == 4
    # the page comes after all
    land(pages / "project=CUT", 1, 2, ["CUT-2"])
    summary, _ = ingest_issue_pages(lake, str(pages), "points", "sprint", AS_OF, run_id="r2")
    assert {r["project_key"]: r["status"] for r in summary.collect()}["CUT"] == "success"
    assert {"CUT-1", "CUT-2"} <= {r["issue_key"] for r in lake.read_silver("jira", newest_only=True).collect()}


def test_places_of_pages_without_a_named_folder(spark, tmp_path):
    land(tmp_path / "x", 0, 1, ["P-1"])
    (tmp_path / "x" / "other.json").write_text('"no page"\n\n[1, 2]\n')
    rows = issue_page_places(spark, str(tmp_path / "x"), "points", "sprint").collect()
    assert sorted((str(r["project_key"]), r["rejected"], r["n"]) for r in rows) == [("None", True, 0), ("None", True, 0), ("P", False, 1)]


def test_unreadable_updates_are_kept(spark, lake, make_tickets):
    lake.save_state(spark.createDataFrame([("PROJ", "2024-01-05 00:00")], STATE))
    batch = make_tickets(ticket(1, updated=None), ticket(2, updated="soon"), ticket(3, updated="2024-02-01T00:00:00Z"), ticket(4, updated="2023-02-01T00:00:00Z"))
    ingest_tickets(lake, batch, AS_OF, run_id="r1")
    assert sorted(r["issue_key"] for r in lake.read_silver("jira", schema=TICKET).collect()) == ["PROJ-1", "PROJ-2", "PROJ-3"]
    assert [r["reason"] for r in read_rejects(lake).collect()] == ["unreadable update"] * 2
    assert lake.load_state().first()["last_ingest_date"].startswith("2024-02-01")


def test_loads_that_overlap_keep_both_marks(spark, lake):
    lake.save_state(spark.createDataFrame([("A", "2024-01-01 00:00"), ("B", "2024-01-01 00:00"), ("ODD", "some day"), ("NONE", None)], STATE))
    start = [tuple(r) for r in lake.load_state().collect()]
    state = spark.createDataFrame(start, STATE)
    one = spark.createDataFrame([("A", "2024-03-01T00:00:00Z")], "project_key string, updated string")
    two = spark.createDataFrame([("B", "2024-02-01T00:00:00Z"), ("A", "2024-02-01T00:00:00Z")], "project_key string, updated string")
    for batch in (one, two):  # the second load started from the same marks and ends last
        lake.save_state(I.advance_marks(state, batch))
    want = {"A": "2024-03-01T00:00:00.000000Z", "B": "2024-02-01T00:00:00.000000Z", "ODD": "some day"}
    assert dict(map(tuple, lake.load_state().collect())) == want
    lake.compact_state()
    assert dict(map(tuple, lake.load_state().collect())) == want
    assert spark.read.parquet(lake.path("state", "marks")).select("run").distinct().count() == 1


def test_schemas_are_united(spark, lake):
    def gold(day, row, schema):
        lake.write_gold(spark.createDataFrame([row], "project_key string, " + schema), run_date=f"2024-01-0{day}")

    gold(1, ("P", 1, 1.5, (1, "x"), [1]), "n int, f float, s struct<a:int,b:string>, l array<int>")
    gold(2, ("P", 1 << 40, 2.25, (1 << 40, 7), [1 << 40]), "n long, f double, s struct<a:long,c:int>, l array<long>")
    gold(3, ("P", "more"), "extra string")
    rows = lake.read_gold().orderBy("date").collect()
    assert [(r["n"], r["f"], r["extra"]) for r in rows] == [(1, 1.5, None), (1 << 40, 2.25, None), (None, None, "more")]
    assert [r["s"] and tuple(r["s"]) for r in rows] == [(1, "x", None), (1 << 40, None, 7), None]
    assert [r["l"] for r in rows] == [[1], [1 << 40], None]
    assert lake.read_gold(date="2024-01-03").first()["extra"] == "more"
    gold(4, ("P", "text"), "n string")
    with pytest.raises(SchemaConflict, match="column n"):
        lake.read_gold()


def test_union_rules():
    def one(kind):
        return T.StructType([T.StructField("x", kind)])

    def both(a, b):
        return union_of([one(a), one(b)])["x"].dataType

    assert both(T.ByteType(), T.LongType()) == both(T.LongType(), T.ByteType()) == T.LongType()
    assert both(T.IntegerType(), T.DoubleType()) == T.DoubleType()
    assert both(T.DecimalType(10, 2), T.DecimalType(12, 6)) == T.DecimalType(14, 6)
    assert both(T.NullType(), T.StringType()) == T.StringType()
    assert both(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    for a, b in ((T.LongType(), T.DoubleType()), (T.StringType(), T.LongType()), (T.DecimalType(38, 0), T.DecimalType(38, 10)), (T.IntegerType(), T.FloatType())):
        with pytest.raises(SchemaConflict):
            both(a, b)
    with pytest.raises(SchemaConflict, match="case"):
        union_of([T.StructType([T.StructField("x", T.LongType())]), T.StructType([T.StructField("X", T.LongType())])])


def test_runs_of_gold(spark, lake):
    def rows(*values):
        return spark.createDataFrame(values, "project_key string, v int")

    lake.write_gold(rows(("P", 1), ("A b", 2)), run_date="2024-01-01", run_id="r1")
    lake.write_gold(rows(("P", 1), ("A b", 2)), run_date="2024-01-01", run_id="r1")
    assert sorted(r["v"] for r in lake.read_gold().collect()) == [1, 2]
    lake.write_gold(rows(("P", 3)), run_date="2024-01-01", run_id="r2")
    lake.write_gold(rows(("P", 4)), run_date="2024-01-02", run_id="r1")
    assert sorted(r["v"] for r in lake.read_gold().collect()) == [2, 3, 4]
    assert [r["v"] for r in lake.read_gold(projects="A b").collect()] == [2]
    assert [r["v"] for r in lake.read_gold(date="2024-01-02").collect()] == [4]
    lake.write_gold(rows(("P", 5)), run_date="2024-01-02")
    assert sorted(r["v"] for r in lake.read_gold(projects=["P"]).collect()) == [3, 4, 5]
    assert set(lake.read_gold().columns) == {"project_key", "v", "project", "date"}


def test_messages_loaded_twice(spark, lake):
    rows = [("P", "C1", str(1704067200 + 3600 * i), f"message {i}", 0.5) for i in range(30)]
    messages = spark.createDataFrame(rows, "project_key string, channel_id string, message_ts string, text string, sentiment_score double")
    for _ in range(2):
        ingest_messages(lake, messages, AS_OF, run_id="r1")
    assert lake.read_silver("slack").count() == 30
    assert lake.read_gold(fv.SENTIMENT_FEATURE_SET).groupBy().sum("message_count").first()[0] == 30


def test_a_stream_of_pages_stores_rejects_once(spark, lake, tmp_path):
    pages, checkpoint = tmp_path / "pages", str(tmp_path / "checkpoint")

    def stored():
        names = [sorted(r["issue_key"] for r in read.collect()) for read in (lake.read_silver("jira", schema=TICKET), lake.read_bronze("jira", TICKET))]
        assert names[0] == names[1]
        return names[0], [(r["project_key"], r["reason"]) for r in read_rejects(lake).collect()]

    land(pages / "project=P", 0, 2, ["P-1", "P-2"])
    land(pages / "project=P", 2, 2, ["P-3", "P-4"], cut=True)
    stream_pages(lake, str(pages), "points", "sprint", checkpoint, run_date=AS_OF).awaitTermination()
    assert stored() == (["P-1", "P-2"], [("P", "unreadable page")])
    # the batch is run again, as after a failure before its commit
    store = page_batch(lake, "points", "sprint", AS_OF)
    store(page_texts(spark.read, str(pages)), 0)
    assert stored() == (["P-1", "P-2"], [("P", "unreadable page")])
    land(pages / "project=Q", 0, 1, ["Q-1"])  # only this is new to the stream
    stream_pages(lake, str(pages), "points", "sprint", checkpoint, run_date=AS_OF).awaitTermination()
    assert stored() == (["P-1", "P-2", "Q-1"], [("P", "unreadable page")])


def test_a_registered_table_is_changed_in_place(spark, lake):
    def gold(day, row, schema):
        return lake.write_gold(spark.createDataFrame([row], "project_key string, " + schema), run_date=f"2024-01-0{day}")

    by, columns = [("project", "string"), ("date", "string")], [("project_key", "string"), ("a", "int")]
    path = gold(1, ("P", 1), "a int")
    register_table(spark, "loads", "features", path, columns, by)
    created = spark.sql("DESCRIBE TABLE EXTENDED loads.features").where("col_name = 'Created Time'").first()
    gold(2, ("it's", 2, "x"), "a int, b string")
    table = register_table(spark, "loads", "features", path, [*columns, ("b", "string")], by)
    assert sorted((r["a"], r["b"]) for r in table.collect()) == [(1, None), (2, "x")]
    assert created == spark.sql("DESCRIBE TABLE EXTENDED loads.features").where("col_name = 'Created Time'").first()
    gold(3, ("P", 3), "a int")
    gold(4, ("P", 4), "a int")
    table = register_table(spark, "loads", "features", path, columns, by, added=[("P", "2024-01-03")])
    assert sorted(r["a"] for r in table.collect()) == [1, 2, 3]  # what the caller names is added, nothing is dropped
    with pytest.raises(SchemaConflict, match="column a"):
        register_table(spark, "loads", "features", path, [("a", "string")], by)
    other = Lake(spark, lake.root + "-other")
    path = other.write_gold(spark.createDataFrame([("P", 9)], "project_key string, a int"), run_date="2024-01-01")
    assert [r["a"] for r in register_table(spark, "loads", "features", path, columns, by).collect()] == [9]
