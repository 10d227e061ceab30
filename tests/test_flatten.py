import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lateline.functions.sprint import parse_sprint
from lateline.operators import flatten as L
from lateline.schemas import FIELD, TICKET
from lateline.sources.pages import read_issue_pages, read_message_pages, rejected_issue_pages, rejected_message_pages

POINTS, SPRINT = "customfield_1", "customfield_2"
TEXT = "org.plan.Lap@beef[goal=,state=FUTURE,id=6001,name=Harvest / lap C,completeDate=<null>,endDate=2031-09-09]"


def sprint(spark, text):
    row = spark.createDataFrame([(text,)], "e string").select(parse_sprint(F.col("e")).alias("s")).first()["s"]
    return None if row is None else tuple(row)


@pytest.mark.parametrize(
    "text, expected",
    [
        (TEXT, ("6001", "Harvest / lap C", "FUTURE", None, "2031-09-09", None)),
        ('{"id": 3, "name": "S", "completeDate": null}', ("3", "S", None, None, None, None)),
        ("x[id=1, name = a=b ,id=2,goal]", ("2", "a=b", None, None, None, None)),
        ("x[name=[Q1] plan,id=9]", ("9", "[Q1] plan", None, None, None, None)),
        ("x[id=,name=\nline\n]", ("", "line", None, None, None, None)),
        ("x[]", (None,) * 6),
        ("not a sprint", None),
        ("", None),
        (None, None),
    ],
)
def test_sprint_entries(spark, text, expected):
    assert sprint(spark, text) == expected


def issue(number=1, **fields):
    """A beehive inspection, with one of everything the flattening looks at."""
    base = {
        "project": {"key": "HIVE"},
        "summary": "Queen not seen in box 4",
        "description": "brood pattern patchy, check again at dusk",
        "status": {"name": "Waiting for weather", "statusCategory": {"name": "To Do"}},
        "priority": {"name": "Lowest"},
        "issuetype": {"name": "Inspection"},
        "assignee": {"displayName": "Ottilie"},
        "reporter": {"displayName": "Bo"},
        "created": "2031-05-02T05:06:07.890+0200",
        "updated": "2031-06-11T21:00:01.000+0200",
        "duedate": "2031-07-30",
        "resolutiondate": None,
        POINTS: 0.5,
        SPRINT: ["no lap", {"id": 77, "name": "Bloom"}, TEXT],
        "labels": ["north", "shade"],
        "components": [{"name": None}, {"name": "box 4"}, {"name": "lid"}],
        "issuelinks": [
            {"type": None},
            {"type": {"name": "Shares frame"}, "inwardIssue": {"key": "HIVE-31"}},
            {"type": {"name": "Follows"}, "outwardIssue": {"key": "HIVE-8"}},
        ],
        "comment": {"total": 12},
    }
    return {"id": str(number), "key": f"HIVE-{number}", "fields": {**base, **fields}}


def test_issue_pages(spark, tmp_path):
    empty = {name: None for name in issue()["fields"] if name != "project"}
    pages = [
        {"startAt": 0, "total": 4, "issues": [issue(1), issue(2, **empty)]},
        {"startAt": 2, "total": 4, "issues": [{"id": "3", "key": "HIVE-3", "fields": {}}, issue(4, **{POINTS: "many"})]},
        {"startAt": 4, "total": 4, "issues": []},
        {"startAt": 4, "total": 4},
    ]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    df = read_issue_pages(spark, str(tmp_path), POINTS, SPRINT, "2024-02-01")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TICKET]
    got = {r["issue_id"]: r.asDict(recursive=True) for r in df.collect()}
    assert set(got) == {"1", "2", "3", "4"}
    full = got["1"]
    assert (full["issue_key"], full["status"], full["status_category"]) == ("HIVE-1", "Waiting for weather", "To Do")
    assert (full["story_points"], full["assignee"], full["comment_count"]) == (0.5, "Ottilie", 12)
    assert full["components"] == [None, "box 4", "lid"] and full["labels"] == ["north", "shade"]
    assert [s["sprint_id"] for s in full["sprint_history"]] == ["77", "6001"]
    assert full["issue_links"] == [
        {"type": None, "direction": "inward", "linked_issue": None},
        {"type": "Shares frame", "direction": "inward", "linked_issue": "HIVE-31"},
        {"type": "Follows", "direction": "outward", "linked_issue": "HIVE-8"},
    ]
    assert full["ingested_at"] == "2024-02-01T00:00:00Z"
    for number in ("2", "3"):
        bare = got[number]
        assert (bare["assignee"], bare["story_points"], bare["priority"], bare["comment_count"]) == (None, None, None, 0)
        assert bare["labels"] == bare["components"] == bare["sprint_history"] == bare["issue_links"] == []
    assert got["4"]["story_points"] is None


def test_unreadable_pages_are_kept(spark, tmp_path):
    whole = json.dumps({"issues": [issue(1)]})
    (tmp_path / "good.json").write_text(whole + "\n\n")
    (tmp_path / "bad.json").write_text(whole[: len(whole) // 2] + "\n" + '{"issues": "none"}\n')
    assert [r["issue_id"] for r in read_issue_pages(spark, str(tmp_path), POINTS, SPRINT).collect()] == ["1"]
    lost = rejected_issue_pages(spark, str(tmp_path), POINTS, SPRINT).collect()
    assert {r["raw"] for r in lost} == {whole[: len(whole) // 2], '{"issues": "none"}'}
    assert all(r["file"].endswith("bad.json") for r in lost)
    (tmp_path / "page").mkdir()
    (tmp_path / "page" / "one.json").write_text('{"channel":\n"C1", "messages": [}')
    assert rejected_message_pages(spark, str(tmp_path / "page"), multi_line=True).count() == 1


def test_message_pages(spark, tmp_path):
    messages = [
        {"user": "U1", "text": "Shipped it", "ts": "1700000000.5", "reply_count": 2, "reactions": [{"name": "a", "count": 2}, {"name": "b"}, {"name": "c", "count": 3}]},
        {"user": "U2", "text": "joined", "ts": "1700000001", "subtype": "channel_join"},
        {"user": "U3", "text": "  \n", "ts": "1700000002"},
        {"user": "U4", "ts": "1700000003"},
        {"user": "U5", "text": "an outage", "subtype": "thread_broadcast", "ts": ""},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"channel": "C1", "messages": messages, "has_more": False}))
    rows = {r["user_id"]: r for r in read_message_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"U1", "U5"}
    first = rows["U1"]
    assert (first["reply_count"], first["reaction_count"], first["datetime_utc"]) == (2, 5, "2023-11-14T22:13:20Z")
    assert first["sentiment_score"] > 0 > rows["U5"]["sentiment_score"]
    assert (rows["U5"]["datetime_utc"], rows["U5"]["reaction_count"], rows["U5"]["reply_count"]) == (None, 0, 0)
    ranged = read_message_pages(spark, str(tmp_path), oldest="1700000000", latest="1700000001")
    assert [r["user_id"] for r in ranged.collect()] == ["U1"]


def test_resolve_field(spark):
    fields = spark.createDataFrame([("customfield_9", "Story Points", True), ("summary", "Summary", False)], FIELD)
    assert L.resolve_field(fields, "Story Points") == "customfield_9"
    assert L.resolve_field(fields, "Summary") == "summary"
    with pytest.raises(KeyError):
        L.resolve_field(fields, "Velocity")


def test_export_clean(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, nan, datetime(2024, 1, 2, 3, 4, 5), "x"), (2, inf, datetime(2024, 1, 2, 3, 4, 5, 600), "y"), (3, 0.123456, None, None), (4, None, None, "")]
    df = L.export_clean(spark.createDataFrame(rows, "id int, v double, at timestamp, _secret string"))
    assert df.columns == ["id", "v", "at"]
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert [g[1] for g in got] == [0.0, 0.0, 0.1235, 0.0]
    assert [g[2] for g in got] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000600+00:00", None, None]


def test_nested_to_json(spark):
    df = spark.createDataFrame([(1, ["a"], {"k": 1}, (2,)), (2, None, None, None)], "id int, a array<string>, m map<string,int>, s struct<v:int>")
    got = [tuple(r) for r in L.nested_to_json(df).orderBy("id").collect()]
    assert got == [(1, '["a"]', '{"k":1}', '{"v":2}'), (2, None, None, None)]


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("project", ["PROJ", "MY_PROJECT", "AB", "P123"], ["", "a", "proj", "P", "../../etc", "A" * 21, "PROJ-1", None]),
        ("issue", ["PROJ-1", "MY_PROJ-9999999"], ["", "PROJ", "PROJ-", "../p-1", "proj-1", "PROJ-12345678", None]),
    ],
)
def test_key_formats(spark, kind, good, bad):
    df = spark.createDataFrame([(k,) for k in good + bad], "k string")
    valid, invalid = L.split_by_key(df, "k", kind)
    assert {r["k"] for r in valid.collect()} == set(good)
    assert {r["k"] for r in invalid.collect()} == set(bad)
