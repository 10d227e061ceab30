"""Token ids in Simple-8b: 64-bit words whose four-bit selectors say how many ids each one packs.

A word packs 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of equal width, or stands
for 240 zeros. An id of more than 60 bits is an escape: its word holds a place in a
list of whole ids behind the block. Ids are cut into blocks of BLOCK ids; the
offsets of the blocks' words and escapes come before them, so any block can be
decoded alone and all of a frame at once, each selector by one shift and mask.

A file is a row of frames, each a header, the documents' ids and sizes, the offsets,
words and escapes, all 64-bit little-endian, and a 16-byte mark. Documents lie whole in a
frame. The header is a magic number, a mask, a checksum, shard, ids of the shard before
it, documents, ids, blocks and escapes. What comes after the mask is combined with it by
exclusive or; the mask is 0 unless the mark would occur inside. So frames are read as
lines that end in the mark: files can be split, and lie in any store Spark can use.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline.llm.common import map_batches
from lateline.llm.tokens import chunk_encoder
from lateline.sources.staging import new_path, settle

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
BLOCK = 16_384
FRAME_IDS = 1 << 18  # a frame is closed at so many ids; a longer document makes a longer frame
MARK = "\n<end-of-frame>\n"
MAGIC = int.from_bytes(b"simple8b", "little")
_HEADER = 9
_ESCAPE = 1
_WIDTHS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])  # by selector
_COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_LOW = np.uint64((1 << 60) - 1)
_NULL = np.uint64(1 << 63)  # in a document's size: its doc_id is null

# ---- words -------------------------------------------------------------------


def pack(ids):
    """(words, escapes) of one block of unsigned ids."""
    n = len(ids)
    wide = np.zeros(n + int(_COUNTS[0]), np.int8)  # bits of each id; behind the end everything fits
    halves = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1], np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    wide[:n] = np.where(halves[0] > 0, halves[0] + 32, halves[1])
    widest, best = int(wide.max(initial=0)), np.full(n, _ESCAPE, np.int8)
    spans = {1: wide}  # the widest of so many ids from each place on
    for size in (1, 2, 4, 8, 16, 32, 64):
        spans[2 * size] = np.maximum(spans[size][:-size], spans[size][size:])
    for selector in range(15, -1, -1):  # the more ids a word packs, the later it is tried
        width, count = int(_WIDTHS[selector]), int(_COUNTS[selector])
        if width >= widest and selector != _ESCAPE:
            best[:] = selector
        elif selector != _ESCAPE:
            size = 1 << count.bit_length() - 1
            span = np.maximum(spans[size][:n], spans[size][count - size : count - size + n])
            np.copyto(best, np.int8(selector), where=span <= width)
    steps, starts, here = _COUNTS.astype(np.uint8)[best].tobytes(), [], 0
    while here < n:
        starts.append(here)
        here += steps[here]
    starts = np.array(starts, np.int64)
    selectors = best[starts].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        if selector == _ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
        elif selector:
            packed = words[rows]
            for place in range(_COUNTS[selector]):
                packed |= padded[starts[rows] + place] << np.uint64(place * _WIDTHS[selector])
            words[rows] = packed
    return words, ids[starts[selectors == _ESCAPE]]


def unpack(words, word_ends, escapes, escape_ends, n):
    """The n ids of blocks that lie one after the other; all but the last hold BLOCK ids."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    block = np.repeat(np.arange(len(word_ends)), np.diff(word_ends, prepend=0))
    before = np.cumsum(counts) - counts
    first = np.append(0, word_ends[:-1])
    starts = before - before[first][block] + block * BLOCK if len(words) else before
    limits = np.minimum((block + 1) * BLOCK, n)  # the last word of a block may be padded
    out = np.zeros(n, np.uint64)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        if selector == _ESCAPE:
            base = np.append(0, escape_ends[:-1])[block[rows]]
            out[starts[rows]] = escapes[base + (words[rows] & _LOW).astype(np.int64)]
        elif selector:
            place = np.arange(_COUNTS[selector])
            mask = np.uint64((1 << int(_WIDTHS[selector])) - 1)
            values = (words[rows][:, None] & _LOW) >> (place * _WIDTHS[selector]).astype(np.uint64) & mask
            to = starts[rows][:, None] + place
            inside = to < limits[rows][:, None]
            out[to[inside]] = values[inside]
    return out


# ---- frames ------------------------------------------------------------------


def frame(shard, first, doc_ids, sizes, ids):
    """The bytes of one frame; a doc_id may be None."""
    names = np.array([doc_id or 0 for doc_id in doc_ids], np.int64).view(np.uint64)
    marked = np.array(sizes, np.uint64) | np.array([_NULL if d is None else 0 for d in doc_ids], np.uint64)
    packed = [pack(ids[at : at + BLOCK].astype(np.uint64)) for at in range(0, len(ids), BLOCK)]
    ends = [np.cumsum([len(part[side]) for part in packed], dtype=np.int64).astype(np.uint64) for side in (0, 1)]
    body = [names, marked, *ends, *[part[0] for part in packed], *[part[1] for part in packed]]
    numbers = [shard, first, len(sizes), len(ids), len(packed), sum(len(part[1]) for part in packed)]
    rest = np.concatenate([np.array(numbers, np.uint64), *body]).astype("<u8")
    rest = np.concatenate([np.array([zlib.crc32(rest.tobytes())], "<u8"), rest])
    mark, mask = MARK.encode(), 0
    while True:
        raw = np.array([MAGIC, mask], "<u8").tobytes() + (rest ^ np.uint64(mask)).tobytes()
        if (raw + mark).find(mark) == len(raw):
            return raw
        mask = (mask * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & (1 << 64) - 1


def read_frame(raw):
    """(shard, first, doc_ids, sizes, ids) of a frame's bytes; an error if it is damaged."""
    if len(raw) % 8 or len(raw) < 8 * _HEADER:
        raise ValueError("damaged frame: length")
    words = np.frombuffer(raw, "<u8")
    rest = words[2:] ^ words[1]
    if words[0] != MAGIC or zlib.crc32(rest[1:].tobytes()) != rest[0]:
        raise ValueError("damaged frame: magic number or checksum")
    shard, first, docs, n, blocks, escapes = rest[1:7].astype(np.int64).tolist()
    names, sizes, word_ends, escape_ends, words = np.split(rest[7:], np.cumsum([docs, docs, blocks, blocks]))
    words, escaped = np.split(words, [len(words) - escapes])
    ids = unpack(words, word_ends.astype(np.int64), escaped, escape_ends.astype(np.int64), n)
    null = (sizes & _NULL) != 0
    doc_ids = [None if gone else name for gone, name in zip(null.tolist(), names.view(np.int64).tolist(), strict=True)]
    return shard, first, doc_ids, (sizes & ~_NULL).astype(np.int64), ids


# ---- files -------------------------------------------------------------------


def write_ids(docs, path, vocabulary=VOCABULARY, end_id=END_ID, frame_ids=FRAME_IDS):
    """Write the ids of every row of `docs` (doc_id, text), each followed by `end_id`, in ascending doc_id order.

    A null text is an empty one: its document is `end_id` alone. Null doc_ids come
    first; rows of one doc_id are ordered by the hash of their texts. Rows are dealt by
    range, so a doc_id on very many rows is spread over tasks. One file per task
    is written; an empty table gives no frames.
    """

    def frames(batches):
        shard, done = TaskContext.get().partitionId(), 0
        names, sizes, parts, held = [], [], [], 0

        def closed():
            raw = frame(shard, done, names, sizes, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["frame"])

        for batch in batches:
            ids, bounds = chunk_encoder(vocabulary).encode(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            for doc_id, start, end in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                names.append(doc_id)
                sizes.append(end - start)
                parts.append(ids[start:end])
                held += end - start
                if held >= frame_ids:
                    yield closed()
                    done += held
                    names, sizes, parts, held = [], [], [], 0
        if names:
            yield closed()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = docs.repartitionByRange("doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text")
    written = dealt.select("doc_id", "text").mapInArrow(frames, "frame binary")
    # a string column is written byte by byte, whatever its bytes are
    written.select(F.col("frame").cast("string")).write.option("lineSep", MARK).text(path)


def read_ids(spark, path, with_ids=True):
    """(doc_id, shard, at, n_tokens, ids_crc32, ids) of every document of the files, decoded.

    `at` counts the ids before it in its shard; shards are in ascending order. `ids`
    are little-endian unsigned 32-bit integers. A damaged frame is an error.
    """

    def batch_of(batch):
        for raw in batch.column(0):
            shard, first, doc_ids, sizes, ids = read_frame(raw.as_py())
            if len(ids) and int(ids.max()) >> 32:
                raise ValueError("an id of more than 32 bits")
            flat, ends = ids.astype("<u4"), np.cumsum(sizes)
            cuts = [flat[end - size : end].tobytes() for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array(np.full(len(sizes), shard)),
                pa.array(first + ends - sizes),
                pa.array(sizes),
                pa.array([zlib.crc32(cut) for cut in cuts], pa.int64()),
            ]
            columns += [pa.array(cuts, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    frames = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("frame"))
    return map_batches(frames, batch_of, schema)


def with_start(found):
    """The rows of read_ids with `start`: the ids of all documents before each, over all shards."""
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # a window over shards alone, of which there are as many as tasks wrote files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return found.join(totals, "shard").withColumn("start", F.col("at") + F.col("before"))


def query(spark, sf_dir):
    """Every whole text of documents encoded, written, read back; what the files say of each document."""
    from lateline.llm.common import table

    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    found = settle(read_ids(spark, path, with_ids=False), "read")
    return with_start(found).select("doc_id", "start", "n_tokens", "ids_crc32")
