"""Message sentiment, its time series, and drops in it."""

import json
import zlib

from pyspark.sql import functions as F
from pyspark.sql import Window

from lateline import fixed_values as fv
from lateline.functions.numbers import bind, exact_mean, iso_text, number, rounded

LEXICON_SCHEMA = "term string, valence double"
LEXICON = {**fv.GENERAL_LEXICON, **fv.ENGINEERING_LEXICON}
_NOT_A_WORD = r"[^\p{L}\p{N}_']+"


def read_lexicon(spark, path, sep="\t"):
    """A lexicon file (term and valence per line, further columns ignored) as a dict for score_text.

    Terms are lower-cased; a term in twice or a line without a number is refused. A
    lexicon is a word list of bounded size and becomes part of the expression.
    """
    lines = spark.read.schema(LEXICON_SCHEMA).option("sep", sep).option("quote", "").csv(path)
    rows = lines.select(F.lower("term").alias("term"), "valence").collect()
    bad = [row["term"] for row in rows if row["term"] is None or row["valence"] is None]
    lexicon = {row["term"]: row["valence"] for row in rows}
    if bad or len(lexicon) < len(rows):
        raise ValueError(f"{path}: {len(bad)} lines without a valence, {len(rows) - len(lexicon)} repeated terms")
    return lexicon


_TABLE = "array<map<string, struct<valence: double, sizes: array<int>>>>"


def _word_table(lexicon):
    """A lexicon as a hash table in one constant, and the function that looks a column of words up in it.

    An entry is found under the CRC-32 of its words, so a look-up costs the same for
    ten terms and for ten thousand. It holds the term's valence, null if the words are
    no term, and, under the first word of longer terms, their numbers of words,
    longest first.
    """
    entries = {term: {"valence": float(valence), "sizes": []} for term, valence in lexicon.items()}
    sizes = {}
    for term in lexicon:
        words = term.split(" ")
        if len(words) > 1:
            sizes.setdefault(words[0], set()).add(len(words))
    for word, found in sizes.items():
        entries.setdefault(word, {"valence": None, "sizes": []})["sizes"] = sorted(found, reverse=True)
    buckets = [{} for _ in range(1 << len(entries).bit_length())]
    for words, entry in entries.items():
        buckets[zlib.crc32(words.encode("utf-8")) % len(buckets)][words] = entry
    table = F.from_json(F.lit(json.dumps(buckets)), _TABLE)
    return lambda words: F.element_at(F.get(table, F.crc32(words.cast("binary")).bitwiseAND(len(buckets) - 1).cast("int")), words)


def _facts(words, lowered):
    """What every term of a text is held against: where its "but" is, and whether not all of it is in capitals."""
    mixed = F.exists(words, lambda w: F.upper(w) != w)
    return F.struct((F.array_position(lowered, "but") - 1).alias("but"), mixed.alias("mixed"))


def _modified(words, lowered, entries, facts, at):
    """The valence of the one-word term at a position, changed by case and the three words before it."""
    word = F.get(words, at)
    base = F.get(entries, at)["valence"]
    shouted = (F.upper(word) == word) & facts["mixed"]
    start = F.when(shouted, base + F.signum(base) * F.lit(fv.SHOUTED)).otherwise(base)

    def look_back(value, distance):
        before = F.get(lowered, at - distance["d"])
        strength = F.when(before.isin(*fv.BOOSTERS), fv.BOOST).when(before.isin(*fv.DAMPENERS), -fv.BOOST).otherwise(0.0)
        boosted = value + F.signum(value) * strength * distance["fades"]
        turned = F.when(before.isin(*fv.NEGATIONS), F.lit(fv.NEGATION)).otherwise(1.0)
        is_term = F.get(entries, at - distance["d"])["valence"].isNotNull()
        return F.when(before.isNull() | is_term, value).otherwise(boosted * turned)

    steps = [F.struct(F.lit(d).alias("d"), F.lit(f).alias("fades")) for d, f in enumerate(fv.BOOST_BY_DISTANCE, 1)]
    changed = F.aggregate(F.array(*steps), start, look_back)
    but = facts["but"]
    weight = F.when(but < 0, 1.0).when(at < but, fv.BEFORE_BUT).when(at > but, fv.AFTER_BUT).otherwise(1.0)
    return changed * weight


def _emphasis(text):
    exclamations = F.least(F.regexp_count(text, F.lit("!")), F.lit(fv.EXCLAMATIONS_COUNTED)) * F.lit(fv.EXCLAMATION)
    asked = F.regexp_count(text, F.lit(r"\?"))
    questions = F.when(asked <= 1, 0.0).when(asked <= fv.QUESTIONS_COUNTED, asked * F.lit(fv.QUESTION))
    return exclamations + questions.otherwise(fv.MANY_QUESTIONS)


def score_text(text, lexicon=None):
    """Compound score in [-1, 1]: the summed valences s as s / sqrt(s*s + 15).

    `lexicon` maps a term to its valence and is a fixed list, so it is compiled
    into the expression: messages are scored in place, without a join. Words
    before a term strengthen, weaken or negate it; capitals, exclamation marks
    and a "but" weigh in. Terms of several words match neighbouring words and count
    as they are; a term that lies within a longer one does not count beside it.
    """
    find = _word_table(LEXICON if lexicon is None else lexicon)
    words = F.split(text, _NOT_A_WORD)

    def summed(words):
        def of_lowered(lowered):
            return bind(F.transform(lowered, find), lambda entries: bind(_facts(words, lowered), lambda facts: total_of(words, lowered, entries, facts)))

        return bind(F.transform(words, F.lower), of_lowered)

    def total_of(words, lowered, entries, facts):
        def longest_at(at):
            def of_size(n):
                inside = at + n <= F.size(lowered)
                return F.struct(n.alias("n"), F.when(inside, find(F.array_join(F.slice(lowered, at + 1, n), " "))["valence"]).alias("v"))

            return F.get(F.filter(F.transform(F.get(entries, at)["sizes"], of_size), lambda found: found["v"].isNotNull()), F.lit(0))

        def add(seen, at):
            def with_longest(longest):
                end = at + F.coalesce(longest["n"], F.lit(1))
                value = F.when(longest.isNotNull(), longest["v"]).otherwise(_modified(words, lowered, entries, facts, at))
                value = F.when(end > seen["end"], value)
                return bind(value, lambda value: F.struct(
                    (seen["total"] + F.coalesce(value, F.lit(0.0))).alias("total"), F.when(value.isNotNull(), end).otherwise(seen["end"]).alias("end")
                ))

            return bind(longest_at(at), with_longest)

        hits = F.filter(F.transform(entries, lambda entry, i: F.when(entry.isNotNull(), i)), lambda at: at.isNotNull())
        return F.aggregate(hits, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("end")), add)["total"]

    def compound(total):
        loud = total + F.signum(total) * _emphasis(text)
        return F.when(total == 0, 0.0).otherwise(loud / F.sqrt(loud * loud + F.lit(float(fv.SCORE_NORMALISER))))

    return F.coalesce(rounded(bind(bind(words, summed), compound), 4), F.lit(0.0))


def frequent_terms(texts, words=10_000, pairs=1_000):
    """The most frequent words of column `text`, and the most frequent pairs of neighbouring words, as column `term`.

    A lexicon's first draft: a report of stated length, ties broken by the term itself.
    """
    lowered = texts.select(F.transform(F.split("text", _NOT_A_WORD), F.lower).alias("words"))

    def pair(word, i):
        after = F.get("words", i + 1)
        return F.when((word != "") & (after != ""), F.concat(word, F.lit(" "), after))

    def most(terms, n):
        counted = lowered.select(F.explode(terms).alias("term")).where("term <> ''").groupBy("term").count()
        return counted.orderBy(F.col("count").desc(), "term").limit(n).select("term")

    return most(F.col("words"), words).unionAll(most(F.transform("words", pair), pairs))


def write_lexicon(terms, path):
    """A lexicon file from columns term and valence, as `read_lexicon` takes it."""
    terms.select(F.concat_ws("\t", "term", F.col("valence").cast("string"))).write.text(path)


def sent_at(message_ts):
    """Epoch seconds as text to a timestamp; empty or bad text is null."""
    return F.timestamp_seconds(number(message_ts))


def window_unit(window_hours):
    """Windows are hours up to one hour, days beyond."""
    return "hour" if window_hours <= 1 else "day"


def sentiment_series(messages, window_hours=24, keys=("project_key",), unit=None):
    """Mean, count and deviation of message sentiment per hour or day."""
    unit = unit or window_unit(window_hours)
    when = F.date_trunc(unit, sent_at(F.col("message_ts")))
    score = F.col("sentiment_score")
    buckets = (
        messages.withColumn("_start", when)
        .where(F.col("_start").isNotNull())
        .groupBy(*keys, "_start")
        .agg(
            rounded(exact_mean(score), 4).alias("avg_sentiment"),
            F.count("*").alias("message_count"),
            rounded(F.coalesce(F.stddev_samp(score), F.lit(0.0)), 4).alias("std_dev"),
        )
    )
    return buckets.select(*keys, iso_text(F.col("_start")).alias("window_start"), "avg_sentiment", "message_count", "std_dev")


def sentiment_anomalies(series, threshold=fv.ANOMALY_SIGMAS, keys=("project_key",)):
    """Windows further than `threshold` deviations below the mean of all windows.

    The series holds one row per key and hour at most, so a key's window is
    bounded by its time span, however many messages it has.
    """
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    value = F.col("avg_sentiment")
    spread = F.stddev_samp(value).over(every)
    measured = series.withColumns(
        {
            "_windows": F.count("*").over(every),
            "_z": F.try_divide(value - F.avg(value).over(every), F.nullif(spread, F.lit(0.0))),
        }
    )
    dropped = measured.where((F.col("_windows") >= fv.ANOMALY_MIN_WINDOWS) & (F.col("_z") < -threshold))
    return dropped.withColumns(
        {"z_score": rounded(F.col("_z"), 4), "anomaly_type": F.lit(fv.ANOMALY_TYPE)}
    ).drop("_windows", "_z")


def first_anomalies(anomalies, keep=fv.ANOMALIES_KEPT, keys=("project_key",)):
    """The earliest `keep` anomalies per key, with their rank."""
    order = Window.partitionBy(*keys).orderBy("window_start")
    return anomalies.withColumn("anomaly_rank", F.row_number().over(order)).where(F.col("anomaly_rank") <= keep)


def sentiment_outlook(series, windows=fv.OUTLOOK_WINDOWS, keys=("project_key",)):
    """Mean of the last windows and whether it reads positive, negative or neutral."""
    newest = Window.partitionBy(*keys).orderBy(F.col("window_start").desc())
    recent = series.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= windows)
    mean = recent.groupBy(*keys).agg(
        F.avg("avg_sentiment").alias("recent_sentiment"), F.count("*").alias("recent_windows")
    )
    label = (
        F.when(F.col("recent_sentiment") > fv.OUTLOOK_BAND, "positive")
        .when(F.col("recent_sentiment") < -fv.OUTLOOK_BAND, "negative")
        .otherwise("neutral")
    )
    return mean.withColumn("outlook", label)
