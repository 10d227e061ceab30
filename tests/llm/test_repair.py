"""Repair of conversations against a plain dynamic programme over all edits."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lateline.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, row int, edits string"
STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def best_edits(messages):
    """(cost, audit, lines) of messages (role, text, fault): the least of all ways, built from the end."""
    n, ways = len(messages), {}
    for i in range(n, -1, -1):
        options = {q: [] for q in range(4)}
        for q in range(4):
            if i == n and q in (0, 3):
                options[q].append((0, "", ()))
            if i < n:
                role, text, fault = messages[i]
                more = int(fault == "truncated")
                cost, audit, lines = ways[i + 1, q]
                options[q].append((cost + 3, "D" + audit, lines))
                if fault not in ("blank", "duplicate"):
                    for c, to in STATES[q].items():
                        cost, audit, lines = ways[i + 1, to]
                        if role[:1] == c:
                            options[q].append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                        if c in NAMES:
                            options[q].append((cost + 2 + more, "R" + audit, (f"{NAMES[c]}:{text}", *lines)))
        found = {q: min(options[q], default=(1 << 40, "", ())) for q in range(4)}
        for _ in range(5):  # inserts stay at the same message
            for q in range(4):
                for c, to in STATES[q].items():
                    if c in NAMES:
                        cost, audit, lines = found[to]
                        found[q] = min(found[q], (cost + 2, "I" + audit, (f"{NAMES[c]}:", *lines)))
        for q in range(4):
            ways[i, q] = found[q]
    return ways[0, 0]


def faults(messages):
    seen, out = set(), []
    for role, text in messages:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows, damaged=True):
    """{conv_id: result} of rows (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in after.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in found if t is not None]
        messages = faults([r[1:] for r in found])
        cost, audit, lines = best_edits(messages)
        counts = [sum(m[2] == kind for m in messages) for kind in ("blank", "duplicate", "truncated")]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(messages, messages[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def results(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[name] for name in names) for r in rows}


codes = st.lists(st.sampled_from([0, 1, 2, 3, 4, 6, 9, 10, 11]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(codes)
def test_auction_against_the_plain_programme(found):
    roles = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    kinds = {0: None, 4: "blank", 8: "truncated"}
    messages = [(roles[c & 3], "t", kinds[c & 12]) for c in found]
    cost, audit, _ = best_edits(messages)
    prices, traces = repair.solved((*found, 16), repair._DONE)
    edits, state = traces[0]
    assert prices[0][0] == cost and state in (0, 3)
    assert "".join("I" * len(put) + letter for put, letter, _ in edits) == audit


@settings(max_examples=100, deadline=None)
@given(codes, codes, st.integers(0, 3))
def test_distances_add_up(left, right, state):
    whole, one, two = (repair.distances(tuple(c)) for c in (left + right, left, right))
    for to in range(4):
        ways = [one[4 * state + q] + two[4 * q + to] for q in range(4) if min(one[4 * state + q], two[4 * q + to]) >= 0]
        # inserts at the end of a block belong to the next one
        assert min(ways, default=-1) == whole[4 * state + to]


def odd_rows():
    long = [(50, t, ("user", "assistant")[t % 2], f"message {t % 7}" + ("." if t % 3 else "")) for t in range(400)]
    return [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"),
        (2, None, None, None), (2, 1, "tool", "x."), (2, 5, "", "y."), (2, 9, "User", "z."),
        (None, 1, "user", "no conversation?"), (None, None, "assistant", "none.\r\n \x0b"),
        (3, 1, "user", " \t\n"), (4, -5, "assistant", "only."), (5, 1, "system", "only."),
        (6, 1, "user", "word " * 100_000), (7, 2**63 - 1, "user", "far."), (7, -(2**63), "user", "away."),
        (8, 3, "user", "tie b."), (8, 3, "user", "tie a."), (8, 3, "assistant", "tie."), *long,
    ]


@pytest.mark.parametrize("bits", [12, 2, 0])
@pytest.mark.parametrize("damaged", [True, False])
def test_odd_conversations(spark, monkeypatch, bits, damaged):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)  # long conversations lie in many blocks
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 7, "extra") for r in rows], SCHEMA).repartition(3)
    want = plain(rows, damaged)
    want[7] = (0, *want[7][1:]) if len([r for r in rows if r[0] == 7]) == 2 and want[7][0] > 1 << 62 else want[7]
    assert results(repair.report(df, repair.damage(df) if damaged else df)) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.query(spark, str(tmp_path)).collect() == []


def test_repaired_messages_are_whole(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", " ")]
    ordered, coded = repair.diagnose(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = repair.repaired_messages(ordered, repair.repairs(coded)).orderBy("row").collect()
    lines = [(m["role"], m["text"]) for r in found for m in r["lines"]]
    assert lines == [("user", "a."), ("assistant", "b.")]


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(repair.query(spark, sf)) == plain(rows)
