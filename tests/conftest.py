import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lateline.schemas import TICKET  # noqa: E402
from lateline.session import build_session  # noqa: E402

AS_OF = "2024-04-01T00:00:00Z"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ticket(number=1, **changes):
    """A small errand, done a week before it was due, in the only sprint it ever was in."""
    row = {
        "issue_id": str(number),
        "issue_key": f"PROJ-{number}",
        "project_key": "PROJ",
        "summary": f"Ticket {number}",
        "description": "swap the cracked pane in the north greenhouse before the frost",
        "status": "Done",
        "status_category": "Done",
        "priority": "Lowest",
        "issue_type": "Spike",
        "assignee": "ann",
        "reporter": "pam",
        "created": "2023-12-18T06:00:00Z",
        "updated": "2024-02-20T18:36:00Z",
        "due_date": "2024-03-05T12:00:00Z",
        "resolution_date": "2024-02-27T09:15:00Z",
        "story_points": 1.0,
        "labels": [],
        "components": [],
        "sprint_history": [sprint(1)],
        "issue_links": [],
        "comment_count": 4,
        "ingested_at": "2024-02-28T00:00:00Z",
    }
    return {**row, **changes}


def sprint(number):
    return {
        "sprint_id": str(number),
        "sprint_name": f"Sprint {number}",
        "sprint_state": "closed",
        "start_date": None,
        "end_date": None,
        "complete_date": None,
    }


def link(kind, other="PROJ-900"):
    return {"type": kind, "direction": "outward", "linked_issue": other}


def many_tickets(count=120):
    """Tickets of two projects with all the variety the features look at."""
    start = datetime(2024, 1, 1)
    made = []
    for i in range(count):
        made.append(
            ticket(
                i,
                issue_key=f"{'PROJ' if i % 3 else 'ALPHA'}-{i}",
                project_key="PROJ" if i % 3 else "ALPHA",
                status=("To Do", "In Progress", "Done")[i % 3],
                status_category=("To Do", "In Progress", "Done")[i % 3],
                priority=("Highest", "High", "Medium", "Low", "Lowest", None)[i % 6],
                issue_type=("Bug", "Story", "Epic", "Spike")[i % 4],
                assignee=None if i % 7 == 0 else f"dev {i % 5}",
                created=(start + timedelta(days=i % 40, hours=i)).isoformat() + "Z",
                updated=(start + timedelta(days=i % 80)).isoformat() + "Z",
                due_date=(start + timedelta(days=30)).isoformat() + "Z" if i % 2 else None,
                resolution_date=(start + timedelta(days=i)).isoformat() + "Z" if i % 3 == 2 else None,
                story_points=float((1, 2, 3, 5, 8)[i % 5]),
                sprint_history=[sprint(n) for n in range(1 + (i % 4 == 0))],
                issue_links=[link("Blocks"), link("Relates")] if i % 5 == 0 else [],
                comment_count=i % 15,
            )
        )
    return made


@pytest.fixture
def make_tickets(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), TICKET)

    return make


@pytest.fixture
def tickets(make_tickets):
    return make_tickets(*many_tickets())
