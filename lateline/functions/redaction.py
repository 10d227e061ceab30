"""Redaction expressions: secrets, personal entities, spans."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateline import fixed_values as fv
from lateline.functions.numbers import bind, choose, running
from lateline.schemas import SPAN

# a text without any of these (lower case) cannot match the pattern, and a plain
# search is far cheaper than running the pattern over the whole text
_SECRET_NEEDS = {
    "aws_access_key": ("akia",),
    "assigned_secret": ("key", "token", "secret", "password"),
    "database_uri": ("://",),
    "private_key": ("private key-----",),
}
_ANY_ENTITY = "|".join(f"(?:{pattern})" for _, pattern in fv.ENTITY_PATTERNS)
# every entity holds one of these; looking for them first skips most texts
_ENTITY_HINT = r"://|@|[0-9][^A-Za-z]{1,2}[0-9]"


def _holds(text, name):
    needs = _SECRET_NEEDS.get(name)
    if not needs:
        return F.lit(True)
    lowered, found = F.lower(text), F.lit(False)
    for need in needs:
        found = found | lowered.contains(need)
    return found


def secret_patterns(extra=(), aws_secret=False):
    """The patterns in force: the fixed ones, the optional one, the caller's own."""
    optional = (fv.AWS_SECRET_PATTERN,) if aws_secret else ()
    own = tuple((f"extra_{i}", pattern, placeholder) for i, (pattern, placeholder) in enumerate(extra))
    return fv.SECRET_PATTERNS[:1] + optional + fv.SECRET_PATTERNS[1:] + own


def redact_secrets(text, extra=(), aws_secret=False):
    """Replace technical secrets by their placeholders, pattern after pattern."""
    for name, pattern, placeholder in secret_patterns(extra, aws_secret):
        text = F.when(_holds(text, name), F.regexp_replace(text, pattern, placeholder)).otherwise(text)
    return text


def count_secrets(text, extra=(), aws_secret=False):
    """How many places the patterns match in the text."""
    total = F.lit(0)
    for name, pattern, _ in secret_patterns(extra, aws_secret):
        total = total + F.when(_holds(text, name), F.regexp_count(text, F.lit(pattern))).otherwise(0)
    return F.coalesce(total, F.lit(0)).cast("long")


def placeholder_of(entity_type):
    """[TYPE], or the fixed placeholder where the type has its own."""
    return choose(entity_type, fv.ENTITY_PLACEHOLDERS, F.concat(F.lit("["), entity_type, F.lit("]")))


def entity_hits(text):
    """The matched strings, left to right and without overlap."""
    none = F.array().cast(T.ArrayType(T.StringType()))
    found = F.regexp_extract_all(text, F.lit(_ANY_ENTITY), F.lit(0))
    return F.when(text.rlike(_ENTITY_HINT), found).otherwise(none)


def entity_type(hit):
    """Which entity a matched string is."""
    result = None
    for name, pattern in fv.ENTITY_PATTERNS[:-1]:
        matched = hit.rlike(f"^(?:{pattern})$")
        result = F.when(matched, name) if result is None else result.when(matched, name)
    return result.otherwise(fv.ENTITY_PATTERNS[-1][0])


def entity_gaps(text, hits):
    """The texts between the hits, one more than there are hits."""
    return F.when(F.size(hits) == 0, F.array(text)).otherwise(F.split(text, _ANY_ENTITY))


def fill_gaps(gaps, types):
    """Put the placeholders of `types` between the gaps."""
    parts = F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(placeholder_of(F.get(types, i)), F.lit(""))))
    return F.array_join(parts, "")


def entity_spans(text):
    """Entities as spans: type, score, begin and end in characters. Ends are running sums of lengths."""

    def placed(hits, gaps):
        sizes = F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))
        ends = bind(sizes, lambda found: running(found, lambda one, other: one + other))
        return bind(ends, lambda found: F.transform(hits, lambda hit, i: span(hit, F.get(found, i))))

    def span(hit, end):
        begin = end - F.length(hit)
        return F.struct(entity_type(hit).alias("type"), F.lit(1.0).alias("score"), begin.alias("begin"), end.alias("end"))

    # hits and gaps are bound, or the text would be taken apart again for each of them
    return bind(entity_hits(text), lambda hits: bind(entity_gaps(text, hits), lambda gaps: placed(hits, gaps)))


def apply_spans(text, spans):
    """Replace each span by its placeholder. Of spans that overlap, the text up to the furthest end goes once.

    The text is taken apart as four bytes per character, where a piece is found by
    its place, so the work grows with the text and not with spans times text.
    """
    nothing = F.array().cast("array<struct<b:int,e:int,p:string>>")
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["begin"].alias("b"), s["end"].alias("e"), placeholder_of(s["type"]).alias("p")))
    )
    ordered = F.coalesce(ordered, nothing)

    def piece(wide, begin, end):
        size = F.greatest(end - begin, F.lit(0)) * 4
        return F.decode(F.substring(wide, begin * 4 + 1, size), "UTF-32")

    def filled(wide, sorted_spans, reach):
        def before(span, i):
            last = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            return F.concat(piece(wide, last, span["b"]), span["p"])

        tail = F.get(reach, F.size(reach) - 1)
        rest = F.decode(F.substring(wide, tail * 4 + 1, F.greatest(F.octet_length(wide) - tail * 4, F.lit(0))), "UTF-32")
        return F.concat(F.array_join(F.transform(sorted_spans, before), ""), rest)

    def furthest(sorted_spans):  # behind each span, the furthest end so far: a span may hold the next one
        return bind(F.transform(sorted_spans, lambda span: span["e"]), lambda ends: running(ends, F.greatest))

    def replaced(sorted_spans):
        return bind(
            furthest(sorted_spans),
            lambda reach: bind(F.encode(text, "UTF-32"), lambda wide: filled(wide, sorted_spans, reach)),
        )

    return F.when(F.size(ordered) == 0, text).otherwise(bind(ordered, replaced))


def text_chunks(max_bytes=fv.MAX_CHUNK_BYTES):
    """A function from a text column to its chunks of at most `max_bytes` UTF-8 bytes.

    A chunk ends behind its last sentence end or line break where it has one.
    Greedy cutting depends on where the last cut fell, so this one is a small
    Arrow-batched function; the chunks of a text join up to the text.
    """
    if max_bytes < 4:
        raise ValueError("max_bytes must leave room for one character")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts):
        return texts.map(lambda text: None if text is None else _chunks(text, max_bytes))

    return cut


def _chunks(text, max_bytes):
    data, chunks, begin = text.encode("utf-8"), [], 0
    while len(data) - begin > max_bytes:
        end = begin + max_bytes
        while data[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        stop = max(data.rfind(b". ", begin, end), data.rfind(b"\n", begin, end))
        if stop > begin:
            end = stop + 1
        chunks.append(data[begin:end].decode("utf-8"))
        begin = end
    chunks.append(data[begin:].decode("utf-8"))
    return chunks
