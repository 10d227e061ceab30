import hashlib
import random
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lateline.functions import redaction as R
from lateline.functions.numbers import running
from lateline.operators import redaction as O
from lateline.sources.star import with_secrets

KEY = "AKIA" + "ABCDEFGH12345678"
PEM = "-----BEGIN EC PRIVATE KEY-----\nc29tZS1ib2R5\n--odd-dashes--\n-----END EC PRIVATE KEY-----"


def run(spark, text, make):
    return spark.createDataFrame([(text,)], "text string").select(make(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"Use {KEY} now", "Use [AWS_ACCESS_KEY] now"),
        (f"X{KEY}", f"X{KEY}"),
        (f"{KEY}9", f"{KEY}9"),
        ("dump of REDIS://cache-7/3?x=1\tkept", "dump of [DATABASE_URI]\tkept"),
        ("mysql://reader@orchard:3307/apples", "[DATABASE_URI]"),
        (f"a {PEM} b {PEM}", "a [PRIVATE_KEY] b [PRIVATE_KEY]"),
        ('secret: "walnut-grove_77-walnut-grove" end', "[REDACTED_SECRET] end"),
        ("Api-Key=zzzzzzzzzzzzzzzzzzzzz9", "[REDACTED_SECRET]"),
        ("mytoken=abcdefghij0123456789", "mytoken=abcdefghij0123456789"),
        ("étoken=abcdefghij0123456789", "étoken=abcdefghij0123456789"),
        ("token=short", "token=short"),
        ("password = abcdefghij0123456789", "[REDACTED_SECRET]"),
        ("The keys of the boathouse hang by the door", "The keys of the boathouse hang by the door"),
        ("", ""),
        (None, None),
    ],
)
def test_secrets(spark, text, expected):
    assert run(spark, text, R.redact_secrets) == expected


def test_optional_and_own_patterns(spark):
    secret = "a" * 40
    assert run(spark, secret, R.redact_secrets) == secret
    assert run(spark, secret, lambda c: R.redact_secrets(c, aws_secret=True)) == "[AWS_SECRET_KEY]"
    assert run(spark, "badge 77", lambda c: R.redact_secrets(c, extra=[(r"badge \d+", "[BADGE]")])) == "[BADGE]"


def test_secret_count(spark):
    assert run(spark, f"{KEY} and {KEY} or redis://x", R.count_secrets) == 3
    assert run(spark, None, R.count_secrets) == 0


def test_entities_with_offsets(spark):
    text = "Mail ann.b@ex-ample.co.uk, é 10.0.0.7, 4111 1111 1111 1111, 123-45-6789, +1 (212) 555-0199 or https://x.example/a?b=c"
    spans = run(spark, text, R.entity_spans)
    assert [s["type"] for s in spans] == ["EMAIL", "IP_ADDRESS", "CREDIT_DEBIT_NUMBER", "SSN", "PHONE", "URL"]
    assert [text[s["begin"] : s["end"]] for s in spans] == [
        "ann.b@ex-ample.co.uk", "10.0.0.7", "4111 1111 1111 1111", "123-45-6789", "+1 (212) 555-0199", "https://x.example/a?b=c",
    ]
    assert run(spark, "1.2.3.4", R.entity_spans)[0]["type"] == "IP_ADDRESS"
    assert run(spark, "plain text 12", R.entity_spans) == []


def test_spans_are_replaced_from_the_right(spark):
    spans = [("NAME", 0.9, 0, 3), ("PET", 0.8, 8, 11), ("DATE_TIME", 0.7, 12, 16)]
    schema = "text string, spans array<struct<type:string,score:double,begin:int,end:int>>"
    df = spark.createDataFrame([("Ann has Rex 2024!", spans), ("none", []), ("null", None)], schema)
    got = [r[0] for r in df.select(R.apply_spans(F.col("text"), F.col("spans"))).collect()]
    assert got == ["[NAME] has [PET] [DATETIME]!", "none", "null"]


def test_spans_within_a_span_leave_nothing_of_it(spark):
    outer, inner, after = ("NAME", 1.0, 0, 10), ("PET", 1.0, 2, 4), ("AGE", 1.0, 6, 8)
    schema = "n int, text string, spans array<struct<type:string,score:double,begin:int,end:int>>"
    cases = [[inner, outer], [after, inner, outer], [outer, inner, ("AGE", 1.0, 8, 12)], [outer, inner, ("AGE", 1.0, 12, 13)]]
    df = spark.createDataFrame([(n, "0123456789abcdef", spans) for n, spans in enumerate(cases)], schema)
    got = [r[0] for r in df.orderBy("n").select(R.apply_spans(F.col("text"), F.col("spans"))).collect()]
    assert got == ["[NAME][PET]abcdef", "[NAME][PET][AGE]abcdef", "[NAME][PET][AGE]cdef", "[NAME][PET]ab[AGE]def"]


def test_overlapping_spans_and_wide_characters(spark):
    spans = [("PET", 1.0, 4, 8), ("NAME", 1.0, 0, 6), ("AGE", 1.0, 9, 10)]
    schema = "text string, spans array<struct<type:string,score:double,begin:int,end:int>>"
    df = spark.createDataFrame([("ab\U0001f40ddéfgh 1x\U0001f40d", spans)], schema)
    assert df.select(R.apply_spans(F.col("text"), F.col("spans"))).first()[0] == "[NAME][PET] [AGE]x\U0001f40d"


@pytest.mark.parametrize(
    "text",
    [
        "q@b" + ".b" * 500_000,
        "a" * 1_000_000,
        "a." * 500_000 + "@",
        "1-" * 500_000,
        "-----BEGIN RSA PRIVATE KEY-----" + "-" * 1_000_000,
        "token" + " " * 1_000_000,
        "http://" + "x" * 1_000_000,
    ],
    ids=["labels", "letters", "dots", "digits", "dashes", "blanks", "url"],
)
def test_hostile_texts_end_soon(spark, text):
    begun = time.monotonic()
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert O.redact_records(df, ["text"]).first()["text"] is not None
    assert time.monotonic() - begun < 20


def test_many_entities_in_one_text(spark):
    text = "x mail a@b.io " * 10_000
    begun = time.monotonic()
    spans = run(spark, text, R.entity_spans)
    assert len(spans) == 10_000 and spans[-1]["end"] == len(text) - 1
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = df.select("doc_id", F.inline(R.entity_spans(F.col("text"))))
    assert O.apply_span_table(df, rows, "doc_id").first()["text"] == "x mail [EMAIL] " * 10_000
    assert O.redact_records(df, ["text"]).first()["text"] == "x mail [EMAIL] " * 10_000
    assert time.monotonic() - begun < 40


def test_span_table(spark):
    documents = spark.createDataFrame([(1, "call 555"), (2, "clean")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "PHONE", 5, 8)], "doc_id int, type string, begin int, end int")
    got = {r["doc_id"]: r["text"] for r in O.apply_span_table(documents, spans, "doc_id").collect()}
    assert got == {1: "call [PHONE]", 2: "clean"}


def test_redact_records(spark):
    rows = [
        (1, "see a@b.io", "from 10.1.1.1 and b@c.io"),
        (2, f"key {KEY}", None),
        (3, "  ", "fine"),
    ]
    df = spark.createDataFrame(rows, "id int, summary string, description string")
    out = O.redact_records(df, ["summary", "description"])
    assert out.columns == ["id", "summary", "description", "_pii_redaction"]
    got = {r["id"]: r for r in out.collect()}
    assert (got[1]["summary"], got[1]["description"]) == ("see [EMAIL]", "from [IP_ADDRESS] and [EMAIL]")
    mark = got[1]["_pii_redaction"]
    assert mark["entity_types_found"] == ["EMAIL", "IP_ADDRESS"] and mark["pii_detected"]
    assert mark["fields_scanned"] == ["summary", "description"] and not mark["redaction_incomplete"]
    # secrets are counted, but are no personal data
    assert got[2]["summary"] == "key [AWS_ACCESS_KEY]" and got[2]["description"] is None
    assert (got[2]["_pii_redaction"]["pii_detected"], got[2]["_pii_redaction"]["secrets_found"]) == (False, 1)
    assert got[3]["summary"] == "  "
    counts = O.redaction_counts(out).first()
    assert (counts["records"], counts["pii_detected"], counts["secrets_found"]) == (3, 1, 1)


def test_chunks_rejoin_and_fit(spark):
    maker = random.Random(3)
    texts = ["", "short", "Word " * 30_000, "é" * 4_000, "no break" * 900]
    texts += ["".join(maker.choice("ab. \né漢") for _ in range(maker.randint(1, 9_000))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = O.chunk_documents(df, 1_000, "doc_id").orderBy("doc_id", "position").collect()
    for number, text in enumerate(texts):
        mine = [c["chunk"] for c in chunks if c["doc_id"] == number]
        assert "".join(mine) == text
        assert all(len(c.encode()) <= 1_000 for c in mine)
        for part in mine[:-1]:  # cut behind the last break, where the full window has one
            window = text.encode()
            assert part.endswith(("\n", ".")) or (b". " not in part.encode()[1:] and b"\n" not in part.encode()[1:]), window[:20]
    assert R._chunks("short", 99_000) == ["short"]


def test_chunk_of_plain_words_is_cut_at_the_limit():
    assert [len(c) for c in R._chunks("x" * 25, 10)] == [10, 10, 5]
    assert R._chunks("One. Two. Three", 10) == ["One. Two.", " Three"]
    with pytest.raises(ValueError):
        R.text_chunks(3)


def test_placing_spans_takes_time_in_line_with_their_number(spark):
    def seconds(n):
        line = "mail a@b.co or 10.0.0.1 now. "
        df = spark.range(1).select(F.repeat(F.lit(line), n // 2).alias("text"))
        best = []
        for _ in range(3):
            begun = time.perf_counter()
            spans = df.select("text", R.entity_spans(F.col("text")).alias("spans"))
            last, clean = spans.select(F.element_at("spans", -1)["end"], F.md5(R.apply_spans(F.col("text"), F.col("spans")))).first()
            best.append(time.perf_counter() - begun)
        assert last == len(line) * (n // 2) - len(" now. ")
        assert clean == hashlib.md5(b"mail [EMAIL] or [IP_ADDRESS] now. " * (n // 2)).hexdigest()
        return min(best)

    seconds(1_000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 25 * few + 1


def test_running_sums_and_maxima(spark):
    for values in ([], [3], [3, -1], [5, 1, 9, 2, 9, 11, 0], list(range(100, 0, -1))):
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = df.select(running(F.col("v"), lambda a, b: a + b), running(F.col("v"), F.greatest)).first()
        assert (sums, tops) == (list(accumulate(values)), list(accumulate(values, max)))


def test_planted_secrets_leave_nothing(spark):
    rows = [(i, t) for i, t in enumerate(["plain", "", None, "x" * 100_000, "p\n", "q", "r", "again"])]
    df = with_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.select("text", R.redact_secrets(F.col("text")).alias("clean"), R.count_secrets(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [1, 1, 1, 1, 4, 0, 0, 1]
    digests = [hashlib.md5((t or "").encode()).hexdigest() for _, t in rows]
    for r, digest in zip(got, digests, strict=True):
        assert digest not in r["clean"] and digest[:16].upper() not in r["clean"]
        assert (r["clean"] == r["text"]) == (r["n"] == 0)
