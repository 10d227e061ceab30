"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document, next to the measurements it is read
from; which rules it fails is one integer. Policies are versioned sets of rules,
so a document is kept under a policy where the failure bits and the policy's mask
share nothing. How many documents a rule alone removes follows from the counts of
the bit patterns, without another look at the texts.
"""

from pyspark.sql import functions as F

from lateline.llm.common import SPACE, free_name

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_PARTS = "[ \\t\\n\\x0B\\f\\r]+"


def _let(value, body):
    """body(value) with `value` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text):
    """Words of a text: runs of anything but ASCII white space. An empty array for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _PARTS))


def _repeat_words(words):
    """Number of words that stand in a window of WINDOW words found twice or more in the text."""

    def of_hashes(hashes):
        last = F.size(hashes) - WINDOW
        return _let(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
            of_windows,
        )

    def of_windows(windows):
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(_sorted(windows), covered))

    def _sorted(windows):
        return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(ordered):
        n = F.size(ordered)
        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: ((k > 0) & (F.get(ordered, k - 1)["h"] == F.get(ordered, k)["h"]))
            | ((k < n - 1) & (F.get(ordered, k + 1)["h"] == F.get(ordered, k)["h"])),
        )
        places = F.sort_array(F.transform(twice, lambda k: F.get(ordered, k)["i"]))
        return _let(places, count)

    def count(places):
        steps = F.transform(
            places, lambda place, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - place, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    hashes = F.transform(words, lambda word: F.xxhash64(word))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, of_hashes)).cast("long")


def measurements(docs):
    """`docs` with one struct column `m` of all measurements; text null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, SPACE, "")

    def without(characters):
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    counts = _let(lines, lambda found: F.struct(F.size(found).alias("n"), (F.size(found) - F.size(F.array_distinct(found))).alias("dup")))
    of_words = _let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).alias("n"),
            _repeat_words(words).alias("repeat"),
            F.size(F.filter(words, lambda w: w == "|")).alias("bars"),
            F.size(F.filter(words, lambda w: w.endswith("!!"))).alias("shouts"),
        ),
    )
    in_words, in_lines = free_name(docs, "__words"), free_name(docs, "__lines")
    docs = docs.withColumns({in_words: of_words, in_lines: counts})
    measured = F.struct(
        F.col(in_words)["n"].cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        F.col(in_lines)["n"].cast("long").alias("n_lines"),
        F.col(in_lines)["dup"].cast("long").alias("n_dup_lines"),
        F.col(in_words)["repeat"].alias("n_repeat_words"),
        F.col(in_words)["bars"].cast("long").alias("n_bars"),
        F.col(in_words)["shouts"].cast("long").alias("n_shouts"),
    )
    return docs.withColumn("m", measured).drop(in_words, in_lines)


def _m(name):
    return F.col(f"m.{name}")


# A rule's place in the list is its bit. Never reorder or drop one: append, and let policies choose.
RULES = (
    ("too_few_words", lambda: _m("n_words") < 20),
    ("repeated_windows", lambda: 100 * _m("n_repeat_words") > 30 * _m("n_words")),
    ("many_symbols", lambda: 100 * _m("n_symbols") > 60 * _m("n_words")),
    ("repeated_lines", lambda: (_m("n_lines") >= 4) & (100 * _m("n_dup_lines") > 50 * _m("n_lines"))),
    ("long_words", lambda: _m("word_chars") > 20 * _m("n_words")),
    ("word_list", lambda: 100 * _m("n_bars") > 20 * _m("n_words")),
    ("shouting", lambda: 100 * _m("n_shouts") > 30 * _m("n_words")),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}


def mask(names):
    return sum(BIT[name] for name in names)


POLICIES = {
    "base": mask(["too_few_words", "repeated_windows"]),
    "v1": mask(["too_few_words", "repeated_windows", "many_symbols", "repeated_lines"]),
    "v2": mask(BIT),
}
CURRENT = "v2"


def ledger(docs):
    """`docs` with its measurements `m` and the bits of the rules it fails, `failed_bits`.

    Extra columns stay as they are; columns of these two names are replaced.
    """
    judged = measurements(docs.drop("m", "failed_bits"))
    bits = F.lit(0).cast("long")
    for place, (_, fails) in enumerate(RULES):
        bits = bits + F.when(fails(), F.lit(1 << place)).otherwise(0)
    return judged.withColumn("failed_bits", bits)


def fails(policy):
    """Whether the ledger's row fails a rule of the policy (its name, or a mask)."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES.get(policy, policy))) != 0


def ablations(judged, policies=None):
    """Per policy and rule of it: documents that fail the rule, that fail it alone, and that are kept without it.

    Works on counts of bit patterns, at most two to the number of rules rows.
    """
    policies = policies or POLICIES
    patterns = judged.groupBy("failed_bits").agg(F.count("*").alias("n"))
    versions = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(bits).cast("long").alias("mask")) for name, bits in policies.items()])
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items()])
    spread = patterns.select("failed_bits", "n", F.inline(versions)).select("*", F.inline(rules))
    spread = spread.where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    inside = F.col("failed_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    return spread.groupBy("policy", "rule").agg(
        total(inside.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(inside == F.col("bit")).alias("n_failed_alone"),
        total((inside == 0) | (inside == F.col("bit"))).alias("n_kept_without"),
    )


def query(spark, sf_dir):
    """Measurements, base verdict and current verdict of every document."""
    from lateline.llm.common import table

    judged = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[_m(name).alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        fails("base").alias("base_failed"),
        (~fails(CURRENT)).alias("kept"),
        "failed_bits",
    )


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
  FROM docs),
windows AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM split WHERE len(w) >= 8),
hashed AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM windows),
repeated AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM hashed) WHERE c > 1),
covered AS (SELECT rid, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n FROM repeated GROUP BY rid),
m AS (
  SELECT s.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: x = '|')) AS BIGINT) AS n_bars,
         CAST(len(list_filter(w, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_shouts
  FROM split s LEFT JOIN covered c ON s.rid = c.rid),
b AS (
  SELECT *, CAST((n_words < 20)::INT
    + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (100 * n_symbols > 60 * n_words)::INT
    + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (word_chars > 20 * n_words)::INT
    + 32 * (100 * n_bars > 20 * n_words)::INT
    + 64 * (100 * n_shouts > 30 * n_words)::INT AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""
