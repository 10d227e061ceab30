"""Conversations in reply order, by the passages that messages quote.

Lines that open with ">" are quoted, one level per mark. Neighbouring lines of one
level form a passage; its text is normalised (white space, case) and hashed, and so
are the passages and single lines that each message says itself. A quoted passage
is joined to the first message of its conversation that says it, or else to the
first message of the other conversations. The message quoted at the first level is what a message
replies to; following these links gives the thread it belongs to. Within a
conversation, threads stand in the order of their first messages and replies stand
after what they answer, with all quotes taken out.

Only hashes are shuffled, never texts. What is joined is one row per passage and
conversation on one side, so a passage that a third of all messages quote is hot on
the other side alone, and both sides are stored tables, which lets adaptive
execution split it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline.sources.staging import settle

_MARKS = r"^(?:[ \t]*>)+"
_ENDS = r"^[ \t\r]+|[ \t\r]+$"
_ATTRIBUTION = r"(?i)\bwrote:$"


def _let(value, body):
    """body(value) with `value` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _lines(text):
    """Lines of a text as structs (raw, level, body)."""

    def parse(line):
        marks = F.regexp_extract(line, _MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        body = F.regexp_replace(F.substring(line, F.length(marks) + 1, F.length(line)), _ENDS, "")
        return F.struct(line.alias("raw"), level.alias("level"), body.alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), parse)


def _normal(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _passages(lines):
    """Runs of filled lines of one level, as structs (level, bodies)."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: (F.get(lines, i)["body"] != "")
        & ((i == 0) | (F.get(lines, i - 1)["level"] != F.get(lines, i)["level"]) | (F.get(lines, i - 1)["body"] == "")),
    )

    def cut(found):
        def passage(start, k):
            after = F.coalesce(F.get(found, k + 1), F.size(lines))
            run = F.filter(F.slice(lines, start + 1, after - start), lambda line: line["body"] != "")
            return F.struct(F.get(lines, start)["level"].alias("level"), F.transform(run, lambda line: line["body"]).alias("bodies"))

        return F.transform(found, passage)

    return _let(starts, cut)


def _unquoted(text, lines):
    """The text without quoted lines and the lines that announce them; unchanged if nothing is quoted."""

    def own(line, i):
        after, second = F.get(lines, i + 1), F.get(lines, i + 2)
        quoted_next = F.coalesce((after["level"] > 0) | ((after["body"] == "") & (second["level"] > 0)), F.lit(False))
        return (line["level"] == 0) & ~(line["body"].rlike(_ATTRIBUTION) & quoted_next)

    kept = F.transform(F.filter(lines, own), lambda line: line["raw"])
    some = F.exists(lines, lambda line: line["level"] > 0)
    return F.when(some, F.trim(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(text)


def parsed(conversations):
    """conv_id, turn, role and, in struct `p`: the unquoted text, own units and quoted units (level, hash).

    Own units are hashes of passages and of their lines. A quoted unit is a passage;
    it holds the hashes of its lines too, for quotes of a part.
    """
    text = F.col("text").cast("string")

    def hashed(value):
        return F.md5(_normal(value))

    def of_passages(found):
        own = F.filter(found, lambda p: p["level"] == 0)
        units = F.flatten(F.transform(own, lambda p: F.concat(F.array(hashed(F.array_join(p["bodies"], " "))), F.transform(p["bodies"], hashed))))
        quoted = F.filter(found, lambda p: p["level"] > 0)
        quotes = F.transform(
            quoted,
            lambda p: F.struct(
                p["level"].cast("int").alias("level"),
                F.length(F.array_join(p["bodies"], " ")).alias("size"),
                F.array_distinct(F.concat(F.array(hashed(F.array_join(p["bodies"], " "))), F.transform(p["bodies"], hashed))).alias("hashes"),
            ),
        )
        return F.struct(F.array_distinct(units).alias("own"), quotes.alias("quotes"))

    def of_lines(lines):
        return F.struct(_unquoted(text, lines).alias("text"), _let(_passages(lines), of_passages).alias("units"))

    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), _let(_lines(text), of_lines).alias("p")
    )


def quoted_sources(messages):
    """(conv_id, turn, quote, level, source_conv, source_turn) of each quoted passage that some message says itself.

    Sources are other messages: the first one of the conversation if it is earlier,
    else the first one by conversation and turn of all other conversations. For that
    the sources in the two smallest conversations are kept per hash, as one of them
    at most is the quoting one. The whole passage counts before its lines, earlier
    lines before later ones.
    """
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = known.select("conv_id", "turn", F.posexplode("p.units.quotes").alias("quote", "q"))
    units = settle(quotes.select("conv_id", "turn", "quote", "q.level", F.posexplode("q.hashes").alias("rank", "hash")), "quotes")
    asked = units.select("hash").distinct()
    said = known.select("conv_id", "turn", F.explode("p.units.own").alias("hash"))
    here = settle(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here")).join(asked, "hash", "left_semi"), "said")
    # two rows a hash and task are left before the shuffle, so a passage said everywhere meets nowhere
    ranked = here.withColumn("place", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("place <= 2")
    source = F.struct("conv_id", F.col("here").alias("turn"))
    first = ranked.groupBy("hash").agg(*(F.min(F.when(F.col("place") == k, source)).alias(name) for k, name in ((1, "first"), (2, "second"))))
    first = settle(first, "first")
    met = units.join(here, ["hash", "conv_id"], "left").join(first, "hash", "left")
    inside = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn")))
    outside = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    met = met.withColumn("source", F.coalesce(inside, outside)).where("source IS NOT NULL")
    best = F.min(F.struct("rank", "source")).alias("best")
    found = met.groupBy("conv_id", "turn", "quote", "level").agg(best)
    return found.select("conv_id", "turn", "quote", "level", F.col("best.source.conv_id").alias("source_conv"), F.col("best.source.turn").alias("source_turn"))


def threads(replies):
    """(conv_id, turn, thread_turn, depth) from (conv_id, turn, reply_turn), each answering an earlier turn.

    Pointers are doubled until none moves, so a chain of n replies takes log n rounds.
    """
    state = replies.select("conv_id", "turn", F.col("reply_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    state = settle(state, "threads")
    while not state.isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        new = state.join(above, ["conv_id", "up"], "left")
        new = new.select("conv_id", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"))
        new = settle(new, "threads")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return state.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")


def reply_ordered(conversations):
    """Every message of `conversations` (conv_id, turn, role, text) without quotes, with its links and place.

    reply_conv and reply_turn name the message quoted most closely (first level,
    first such passage); thread_turn is the turn that opens its thread, its own where
    it answers nothing in its conversation, depth the number of replies up to it.
    Sorted by conv_id, thread_turn, turn, a conversation is in reply order. Messages
    with the same conv_id and turn share their links; one without either has none.
    A null text stays null.
    """
    messages = parsed(conversations)
    sources = settle(quoted_sources(messages), "sources")
    linked = sources.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"),
        F.min(F.when(F.col("level") == 1, F.struct("quote", "source_conv", "source_turn"))).alias("reply"),
    )
    linked = settle(linked.select("conv_id", "turn", "n_linked", F.col("reply.source_conv").alias("reply_conv"), F.col("reply.source_turn").alias("reply_turn")), "linked")
    inside = linked.where((F.col("reply_conv") == F.col("conv_id")) & (F.col("reply_turn") < F.col("turn")))
    placed = linked.join(threads(inside), ["conv_id", "turn"], "left")
    placed = settle(placed, "placed")
    quotes = F.col("p.units.quotes")
    said = messages.select(
        "conv_id", "turn", "role", F.col("p.text").alias("text"), F.size(quotes).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform(quotes, lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
    )
    joined = said.join(placed, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "text", "n_quotes", "max_level",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def in_order(ordered):
    """The messages sorted for writing: a conversation's messages stand together, in reply order."""
    keys = ["conv_id", "thread_turn", "turn"]
    return ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)


def query(spark, sf_dir):
    """Every message with its links and place; the unquoted text as a digest."""
    from lateline.llm.common import table

    found = reply_ordered(table(spark, sf_dir, "conversations"))
    return found.withColumn("text_md5", F.md5("text")).drop("text")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
raw AS (
  SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM m),
marked AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM raw),
l AS (
  SELECT rid, pos, line, length(marks) - length(replace(marks, '>', '')) AS level,
         regexp_replace(substr(line, length(marks) + 1), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS body FROM marked),
w AS (
  SELECT *, lag(level) OVER o AS before, lag(body) OVER o AS body_before, lead(level) OVER o AS after,
         lead(body) OVER o AS body_after, lead(level, 2) OVER o AS second
  FROM l WINDOW o AS (PARTITION BY rid ORDER BY pos)),
runs AS (
  SELECT *, sum((body <> '' AND (before IS NULL OR before <> level OR body_before = ''))::INT) OVER (PARTITION BY rid ORDER BY pos) AS run FROM w),
passages AS (
  SELECT rid, run, min(level) AS level, list(body ORDER BY pos) AS bodies FROM runs WHERE body <> '' GROUP BY rid, run),
units AS (
  SELECT rid, run, level, unnest(list_concat([array_to_string(bodies, ' ')], bodies)) AS unit,
         unnest(range(len(bodies) + 1)) AS rank FROM passages),
h AS (SELECT rid, run, level, rank, md5(lower(trim(regexp_replace(unit, '\s+', ' ', 'g')))) AS hash FROM units),
said AS (SELECT conv_id, hash, min(turn) AS here FROM h JOIN m USING (rid) WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT hash, {'c': conv_id, 't': here} AS s, row_number() OVER (PARTITION BY hash ORDER BY conv_id) AS place FROM said),
first AS (SELECT hash, min(s) FILTER (WHERE place = 1) AS f, min(s) FILTER (WHERE place = 2) AS g FROM ranked WHERE place <= 2 GROUP BY hash),
met AS (
  SELECT q.conv_id, q.turn, h.run, h.level, h.rank,
         CASE WHEN s.here < q.turn THEN {'c': q.conv_id, 't': s.here} WHEN f.f.c <> q.conv_id THEN f.f ELSE f.g END AS source
  FROM h JOIN m q USING (rid) LEFT JOIN said s ON s.conv_id = q.conv_id AND s.hash = h.hash LEFT JOIN first f ON f.hash = h.hash
  WHERE h.level > 0),
found AS (
  SELECT conv_id, turn, run, level, arg_min(source, rank) AS source FROM met WHERE source IS NOT NULL GROUP BY 1, 2, 3, 4),
linked AS (
  SELECT conv_id, turn, count(*) AS n_linked, arg_min(source, run) FILTER (WHERE level = 1) AS reply FROM found GROUP BY 1, 2),
up AS (
  SELECT conv_id, turn, reply.t AS top, 1 AS depth FROM linked WHERE reply.c = conv_id AND reply.t < turn
  UNION ALL
  SELECT u.conv_id, u.turn, k.reply.t, u.depth + 1 FROM up u JOIN linked k ON k.conv_id = u.conv_id AND k.turn = u.top
  WHERE k.reply.c = k.conv_id AND k.reply.t < k.turn),
top AS (SELECT conv_id, turn, arg_max(top, depth) AS thread_turn, max(depth) AS depth FROM up GROUP BY 1, 2),
own AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (
           WHERE level = 0 AND NOT (regexp_matches(body, '(?i)\bwrote:$') AND coalesce(after > 0 OR (body_after = '' AND second > 0), false))) AS kept,
         max(level) AS max_level FROM w GROUP BY rid),
quoted AS (SELECT rid, count(*) AS n FROM passages WHERE level > 0 GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, CAST(coalesce(q.n, 0) AS BIGINT) AS n_quotes,
       CAST(coalesce((SELECT max(p.level) FROM passages p WHERE p.rid = m.rid), 0) AS BIGINT) AS max_level,
       CAST(coalesce(k.n_linked, 0) AS BIGINT) AS n_linked, k.reply.c AS reply_conv, k.reply.t AS reply_turn,
       coalesce(t.thread_turn, m.turn) AS thread_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
       md5(CASE WHEN m.text IS NULL THEN NULL WHEN o.max_level > 0 THEN trim(coalesce(o.kept, ''), chr(10)) ELSE m.text END) AS text_md5
FROM m LEFT JOIN quoted q USING (rid) LEFT JOIN own o USING (rid)
LEFT JOIN linked k ON k.conv_id = m.conv_id AND k.turn = m.turn
LEFT JOIN top t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
