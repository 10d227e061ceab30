"""Sprint entries: objects, or texts like `...Sprint@1[id=1,name=A,completeDate=<null>]`."""

from pyspark.sql import functions as F

from lateline.fixed_values import WHITE_SPACE_CHARACTERS
from lateline.functions.numbers import bind

# our name -> the tracker's name
PARTS = {
    "sprint_id": "id",
    "sprint_name": "name",
    "sprint_state": "state",
    "start_date": "startDate",
    "end_date": "endDate",
    "complete_date": "completeDate",
}
_OBJECT = "struct<" + ",".join(f"{name}:string" for name in PARTS.values()) + ">"


def _strip(column):
    return F.btrim(column, F.lit(WHITE_SPACE_CHARACTERS))


def _pairs(inner):
    """`key = value` parts of a comma-separated list as structs (k, v); parts without "=" are skipped."""
    parts = F.filter(F.split(inner, ","), lambda part: part.contains("="))
    return F.transform(
        parts,
        lambda part: F.struct(
            _strip(F.substring_index(part, "=", 1)).alias("k"), _strip(F.substr(part, F.instr(part, "=") + 1)).alias("v")
        ),
    )


def parse_sprint_text(entry):
    """A serialized sprint as a struct; null without brackets. Of a repeated key the last counts."""
    inner = F.regexp_extract(entry, r"(?s)\[(.*)\]", 1)
    nothing = F.struct(*[F.lit(None).cast("string").alias(ours) for ours in PARTS])

    def take(seen, pair):
        taken = [F.when(pair["k"] == theirs, pair["v"]).otherwise(seen[ours]).alias(ours) for ours, theirs in PARTS.items()]
        return F.struct(*taken)

    def finish(seen):
        return F.struct(*[F.nullif(seen[ours], F.lit("<null>")).alias(ours) for ours in PARTS])

    return F.when(entry.contains("[") & entry.contains("]"), F.aggregate(_pairs(inner), nothing, take, finish))


def parse_sprint(entry):
    """A sprint entry, as its JSON text or serialized, as a struct."""
    from_object = bind(
        F.from_json(entry, _OBJECT),
        lambda read: F.struct(*[read[theirs].alias(ours) for ours, theirs in PARTS.items()]),
    )
    return F.when(F.ltrim(entry).startswith("{"), from_object).otherwise(parse_sprint_text(entry))


def parse_sprint_history(entries):
    """All readable sprints of a ticket, in order; null means none."""
    parsed = F.filter(F.transform(entries, parse_sprint), lambda sprint: sprint.isNotNull())
    nothing = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in PARTS) + ">>")
    return F.coalesce(parsed, nothing)
