"""Conversation structure repair: cheapest edits by an auction shortest-path algorithm.

A conversation of n messages is a lattice of n + 1 layers with four nodes each, the states
of the pattern (s?(ua)+)? : nothing yet, system, user, assistant. Deleting, keeping or
re-roling a message leads to the next layer, inserting one stays in the layer; all
costs are whole numbers. The auction keeps a price at every node, never more
than its distance to the end, and a path from an origin: where no arc out of the path's last
node is tight, that node's price rises to the cheapest arc and the path contracts, else it
is extended by the cheapest arc. Origins are taken from the last layer to the first;
a path that reaches a node an earlier path went through is finished, for that price is
exact. In the end all prices are exact duals, and the tight arcs, those whose cost is the
price difference, make up all cheapest repairs. The first letters of the edits
are traced along tight arcs, least letter first.

Conversations are cut into blocks of at most BLOCK messages wherever they are long. Of a
long one, blocks first give the distances between their entry and exit states,
a pass over blocks backwards fixes the prices at their ends, and one forwards the states
in which they are entered. So a conversation of any length is repaired by many tasks.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lateline.llm.common import ready
from lateline.sources.staging import settle

BLOCK_BITS = 12
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_TIE_CHARACTERS = 64  # of a text, in the order of messages of the same turn and role
_FAULTY, _CUT, _END = 4, 8, 16  # bits of a code beside the initial's number; _END closes a conversation
_INITIALS = "?sua"
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_DONE = (0, None, None, 0)  # prices where a conversation may end: nothing at all, or after an assistant
_LEGAL = {"su", "ua", "au"}

# ---- the auction ---------------------------------------------------------------


def _arcs(code):
    """For each state the arcs (letter, cost, stays in its layer, state), in the order of letters."""
    out = []
    for state in range(4):
        moves = [(c, to) for c, to in _NEXT[state].items() if c != "s"]
        inserts = [("I", INSERT, True, to) for _, to in moves]
        if code == _END:
            out.append([("", 0, False, state), *inserts])
            continue
        arcs = [("D", DELETE, False, state), *inserts]
        if not code & _FAULTY:
            more = TRUNCATED if code & _CUT else 0
            kept = _NEXT[state].get(_INITIALS[code & 3])
            arcs += [("K", more, False, kept)] if kept else []
            arcs += [("R", REROLE + more, False, to) for _, to in moves]
        out.append(arcs)
    return out


_ARCS = {code: _arcs(code) for code in (*range(16), _END)}


def _layer(code, onward):
    """Exact prices of a layer by auction, given those of the next; None where the end cannot be reached."""
    arcs = [[a for a in of if a[2] or onward[a[3]] is not None] for of in _ARCS[code]]
    alive = {q for q in range(4) if any(not a[2] for a in arcs[q])}
    while more := {q for q in range(4) if q not in alive and any(a[2] and a[3] in alive for a in arcs[q])}:
        alive |= more
    # no path costs less than the cheapest node of the next layer, so prices may start there
    price = [min(p for p in onward if p is not None) if q in alive else None for q in range(4)]
    exact = [False] * 4
    for origin in alive:
        path = [origin]
        while not exact[path[-1]]:
            node, best, chosen = path[-1], None, None
            for arc in arcs[node]:
                beyond = price[arc[3]] if arc[2] else onward[arc[3]]
                if beyond is not None and (best is None or arc[1] + beyond < best):
                    best, chosen = arc[1] + beyond, arc
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif chosen[2]:
                path.append(chosen[3])
            else:
                break
        for node in path:
            exact[node] = True
    return price


def prices(codes, ends):
    """Prices of all layers of a block, given those at its end."""
    found = [tuple(ends)]
    for code in reversed(codes):
        found.append(_layer(code, found[-1]))
    return found[::-1]


def trace(codes, found, state):
    """(edits, state): the least letters along tight arcs from a state; per message (inserted, letter, role)."""
    edits = []
    for i, code in enumerate(codes):
        inserted = ""
        while True:
            for letter, cost, stays, to in _ARCS[code][state]:
                beyond = found[i if stays else i + 1][to]
                if beyond is not None and found[i][state] == cost + beyond:
                    break
            state = to
            if not stays:
                break
            inserted += _INITIALS[to]
        edits.append((inserted, letter, _INITIALS[state] if letter == "R" else ""))
    return edits, state


def distances(codes):
    """Sixteen numbers: from each entry state to each exit state, -1 where there is no way."""
    columns = [prices(codes, [0 if q == to else None for q in range(4)])[0] for to in range(4)]
    return [-1 if columns[to][q] is None else columns[to][q] for q in range(4) for to in range(4)]


@lru_cache(maxsize=1 << 14)
def _solved(codes, ends):
    found = prices(codes, ends)
    return found, [trace(codes, found, q) if found[0][q] is not None else None for q in range(4)]


def solved(codes, ends):
    """(prices, a trace for each entry state) of a block; short ones are remembered."""
    return _solved(codes, ends) if len(codes) <= 64 else _solved.__wrapped__(codes, ends)


# ---- messages ------------------------------------------------------------------


def damage(conversations):
    """The rows of `conversations` (conv_id, turn, role, text) after the damage that a hash of conv_id and turn deals."""
    name, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(name, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    kept = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.withColumn("copies", F.explode("copies")).drop("copies")


def diagnose(messages):
    """The rows of `messages` (conv_id, turn, role, text) numbered in order, with their faults.

    Returns (ordered, coded): `ordered` has the columns and `row`, whose order is that
    of conversations and of the messages in each: by turn, nulls first; then by role,
    the first characters of the text, and its hash. `coded` has conv_id, turn, row and
    the first fault of each: blank, duplicate, truncated. Rows are dealt by range, so a
    conversation of very many messages is spread over tasks. Nulls in role and
    text count as one space; a null conv_id is a conversation like others.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = messages.select("conv_id", "turn", *filled)
    ties = {"_lead": F.substring("text", 1, _TIE_CHARACTERS), "_hash": F.xxhash64("text"), "_any": F.monotonically_increasing_id()}
    order = ["conv_id", "turn", "role", *ties]
    dealt = rows.withColumns(ties).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = settle(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row")), "ordered")

    blank = ~F.col("text").rlike(r"[^ \t-\r]")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    slim = ordered.select(
        "conv_id", "turn", "row", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), last.isin(".", "!", "?").alias("whole"),
        F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256).alias("said"),
    )
    first = slim.where(~F.col("blank")).groupBy("conv_id", "said").agg(F.min("row").alias("row"))
    first = first.select("row", F.lit(True).alias("first"))
    marked = slim.drop("said").join(first, "row", "left")
    repeated = ~F.col("blank") & F.col("first").isNull()
    coded = marked.select(
        "conv_id", "turn", "row", "initial", "blank",
        repeated.alias("duplicate"),
        (~F.col("blank") & ~repeated & ~F.col("whole")).alias("truncated"),
    )
    return ordered, settle(coded, "coded")


# ---- blocks --------------------------------------------------------------------


def _blocks(coded):
    """(conv_id, start, rows, codes, lone): the messages of each block; a conversation's last one ends in _END."""
    number = F.instr(F.lit("sua"), F.col("initial"))
    number = F.when(F.col("initial") == "", 0).otherwise(number)
    code = number + F.when(F.col("blank") | F.col("duplicate"), _FAULTY).otherwise(0) + F.when(F.col("truncated"), _CUT).otherwise(0)
    cells = coded.select("conv_id", "row", F.shiftright("row", BLOCK_BITS).alias("block"), code.cast("int").alias("code"))
    cells = cells.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("row", "code"))).alias("cells"))
    blocks = cells.select("conv_id", F.col("cells.row")[0].alias("start"), F.col("cells.row").alias("rows"), F.col("cells.code").alias("codes"))
    blocks = settle(blocks, "blocks")
    spans = blocks.groupBy(F.col("conv_id").alias("of")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    closed = F.concat("codes", F.when(F.col("start") == F.col("high"), F.array(F.lit(_END))).otherwise(F.array().cast("array<int>")))
    joined = blocks.join(spans, F.col("conv_id").eqNullSafe(F.col("of")))
    return joined.select("conv_id", "start", "rows", closed.alias("codes"), (F.col("low") == F.col("high")).alias("lone"))


def _per_row(df, function, fields):
    """mapInArrow of a function of a row's values to a tuple, one row each."""
    names, kinds = [name for name, _ in fields], [kind for _, kind in fields]

    def run(batches):
        for batch in batches:
            out = [function(*row) for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields)
    return df.mapInArrow(run, schema)


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())
_SQL = {_LONG: "long", _INT: "int", _TEXT: "string", _LONGS: "array<long>", _TEXTS: "array<string>"}


def _running(df, start, step, fields):
    """Like _per_row over rows sorted by conversation (first column): step(state, *row) -> (state, tuple)."""
    before = [object(), None]

    def one(conversation, *rest):
        state = before[1] if before[0] == conversation else start
        before[1], out = step(state, *rest)
        before[0] = conversation
        return out

    return _per_row(df, one, fields)


def _ends(values):
    return tuple(None if v < 0 else v for v in values)


def _entered(blocks):
    """The blocks with prices at their ends, entry state, and whether the initials at their seam are illegal."""
    lone = blocks.where("lone").withColumns({"ends": F.array(*[F.lit(-1 if p is None else p).cast("long") for p in _DONE]), "state": F.lit(0), "seam": F.lit(0)})
    several = settle(blocks.where("NOT lone"), "several")

    # backwards: the price of leaving a block is that of entering the next
    def leave(after, start, costs):
        ends = after or _DONE
        ways = [[costs[4 * q + to] + ends[to] for to in range(4) if costs[4 * q + to] >= 0 and ends[to] is not None] for q in range(4)]
        return tuple(min(w) if w else None for w in ways), (start, [-1 if p is None else p for p in ends])

    costs = _per_row(several.select("conv_id", "start", "codes"), lambda conv, start, codes: (start, distances(codes)), [("start", _LONG), ("costs", _LONGS)])
    costs = several.select("conv_id", "start").join(costs, "start").select("conv_id", "start", "costs")
    backwards = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("start"))
    ends = settle(_running(backwards, None, leave, [("start", _LONG), ("ends", _LONGS)]), "ends")

    # forwards: each block leads from its entry states to exit states
    def onward(start, codes, ends):
        _, traces = solved(tuple(codes), _ends(ends))
        messages = [c for c in codes if c != _END]
        return start, [-1 if t is None else t[1] for t in traces], _INITIALS[messages[0] & 3], _INITIALS[messages[-1] & 3]

    def enter(before, start, leads, first, last):
        state, initial = before or (0, None)
        return (leads[state], last), (start, state, int(initial is not None and initial + first not in _LEGAL))

    ended = several.join(ends, "start")
    leads = _per_row(ended.select("start", "codes", "ends"), onward, [("start", _LONG), ("leads", _LONGS), ("first", _TEXT), ("last", _TEXT)])
    leads = several.select("conv_id", "start").join(leads, "start").select("conv_id", "start", "leads", "first", "last")
    forwards = leads.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    states = settle(_running(forwards, None, enter, [("start", _LONG), ("state", _INT), ("seam", _INT)]), "states")
    return lone.unionByName(ended.join(states, "start").select(lone.columns))


def repairs(coded):
    """(start, conv_id, cost, illegal, audit, after, edits) of every block; `edits` (row, inserted, edit, to) of its messages.

    `inserted` are the initials of messages put before it, `after` of those put behind
    the conversation, `to` the initial of a new role. Costs and counts of a
    conversation are the sums over its blocks, its audit is theirs in order of `start`.
    """

    def solve(conversation, start, rows, codes, ends, state, seam):
        found, traces = solved(tuple(codes), _ends(ends))
        edits, left = traces[state]
        after = edits[-1][0] if codes[-1] == _END else ""
        beyond = _ends(ends)[left]
        initials = [_INITIALS[c & 3] for c in codes[: len(rows)]]
        illegal = seam + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        audit = "".join("I" * len(inserted) + letter for inserted, letter, _ in edits)
        columns = [list(c) for c in zip(*edits[: len(rows)], strict=True)]
        return start, found[0][state] - beyond, illegal, audit, after, rows, *columns

    entered = _entered(_blocks(coded)).select("conv_id", "start", "rows", "codes", "ends", "state", "seam")
    entered = settle(entered, "entered")
    fields = [("start", _LONG), ("cost", _LONG), ("illegal", _LONG), ("audit", _TEXT), ("after", _TEXT), ("row", _LONGS), ("inserted", _TEXTS), ("edit", _TEXTS), ("to", _TEXTS)]
    solved_blocks = _per_row(entered.select(F.lit(0).alias("conv"), "start", "rows", "codes", "ends", "state", "seam"), solve, fields)
    solved_blocks = solved_blocks.withColumn("edits", F.arrays_zip("row", "inserted", "edit", "to")).drop("row", "inserted", "edit", "to")
    return settle(entered.select("conv_id", "start").join(solved_blocks, "start"), "repairs")


def repaired_messages(ordered, found):
    """(conv_id, row, lines) for every message: the messages (role, text) that stand at its place after repair.

    A deleted message leaves none or those inserted before it. `ordered` comes from diagnose(),
    `found` from repairs().
    """
    edits = found.select("after", F.size("edits").alias("n"), F.posexplode("edits").alias("at", "e"))
    last = F.col("at") == F.col("n") - 1
    edits = edits.select(F.col("e.row").alias("row"), F.col("e.inserted").alias("inserted"), F.col("e.edit").alias("edit"), F.col("e.to").alias("to"), F.when(last, F.col("after")).otherwise("").alias("after"))

    def named(initial):
        return F.when(initial == "u", "user").otherwise("assistant")

    def put(initials):
        letters = F.filter(F.split(initials, ""), lambda c: c != "")
        return F.transform(letters, lambda c: F.struct(named(c).alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("edit") == "R", named(F.col("to"))).otherwise(F.col("role"))
    own = F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    own = F.when(F.col("edit") == "D", F.filter(own, lambda _: F.lit(False))).otherwise(own)
    return ordered.join(edits, "row").select("conv_id", "row", F.concat(put(F.col("inserted")), own, put(F.col("after"))).alias("lines"))


def digests(messages):
    """(conv_id, repaired_sha256) of conversations with messages: SHA-256 of `role:text` lines.

    A SHA-256 has to be fed in order, so a conversation's lines go through one task;
    they stream, and the task holds one batch.
    """

    def run(batches):
        current, digest, fed = None, None, False
        for batch in batches:
            done = []
            for name, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or name != current:
                    done += [(current, digest.hexdigest())] if digest is not None else []
                    current, digest, fed = name, hashlib.sha256(), False
                for line in lines:
                    digest.update((b"\n" if fed else b"") + line.encode("utf-8"))
                    fed = True
            yield rows_of(done)
        yield rows_of([(current, digest.hexdigest())] if digest is not None else [])

    def rows_of(done):
        columns = zip(*done, strict=True) if done else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, _TEXT), strict=True)], ["conv_id", "repaired_sha256"])

    kind = to_arrow_type(messages.schema["conv_id"].dataType)
    lines = F.transform("lines", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    fed = messages.select("conv_id", "row", lines.alias("lines"))
    fed = fed.repartition("conv_id").sortWithinPartitions("conv_id", "row").select("conv_id", "lines")
    return fed.mapInArrow(run, f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def report(conversations, messages):
    """One row per conv_id of `conversations`: faults, costs, audit and digest of the repair of its `messages`.

    Conversations without messages have zeros, an empty audit and the digest of the
    empty string. Other columns are not looked at; an empty table gives no rows.
    """
    ordered, coded = diagnose(messages)
    found = repairs(coded)
    wide = [side("turn").cast("decimal(38,0)") for side in (F.max, F.min)]  # any two longs can be subtracted
    turns = (wide[0] - wide[1] + 1 - F.count_distinct("turn")).try_cast("long")
    faults = coded.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    audits = found.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    parts = conversations.select("conv_id").distinct()
    for more in (faults, audits, digests(repaired_messages(ordered, found))):
        parts = parts.unionByName(more, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name) for name in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark, sf_dir):
    from lateline.llm.common import table

    conversations = table(spark, sf_dir, "conversations")
    ready(spark)
    return report(conversations, damage(conversations))
