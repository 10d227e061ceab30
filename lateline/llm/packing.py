"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of binary lengths: as many whole
sequences of the largest length as fit, then one piece for each bit that is set in
what remains, longest first. Every piece is a sequence of its own; pieces of
equal length form a bucket, from which batches of equal shape are drawn. No
sequence crosses documents and none needs padding, whatever the lengths.
"""

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lateline.llm.bpe import VOCABULARY
from lateline.llm.common import map_batches
from lateline.llm.tokens import chunk_encoder

LONGEST, END_ID = 2048, 1


def piece_lengths(n, longest=LONGEST):
    """Binary lengths that add up to n, longest first; `longest` is a power of two."""
    return [longest] * (n // longest) + [1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if n >> bit & 1]


def pieces(docs, longest=LONGEST, end_id=END_ID, vocabulary=VOCABULARY, with_ids=True):
    """One row per piece of every document (doc_id, text); a null text is an empty one.

    The ids of a document end in `end_id`, so an empty document is one piece of
    length 1. `length` is the piece's bucket. Each piece is its own sequence with a
    number of its own, also where rows are repeated; numbers of a bucket are not dense.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def batch_of(batch):
        ids, bounds = chunk_encoder(vocabulary).encode(batch.column(1))
        ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
        bounds = bounds + np.arange(len(bounds))
        tokens = np.diff(bounds)
        lengths = [piece_lengths(n, longest) for n in tokens.tolist()]
        counts = np.fromiter(map(len, lengths), np.int64, len(lengths))
        length = np.fromiter(chain.from_iterable(lengths), np.int64, int(counts.sum()))
        end = np.cumsum(length)
        raw, cuts = memoryview(ids.tobytes()), list(zip((4 * (end - length)).tolist(), (4 * end).tolist(), strict=True))
        columns = [
            batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
            pa.array(end - length - np.repeat(bounds[:-1], counts)),
            pa.array(length),
            pa.array(np.fromiter((zlib.crc32(raw[a:b]) for a, b in cuts), np.int64, len(cuts))),
            pa.array(np.repeat(tokens, counts)),
        ]
        if with_ids:
            columns.append(pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, [*names, "ids"] if with_ids else names)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = map_batches(docs, batch_of, ", ".join(f"{name} long" for name in names) + (", ids binary" if with_ids else ""))
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed, path):
    """Store the pieces as one folder of files per length, ready to be read in batches of equal shape."""
    packed.write.partitionBy("length").parquet(path)


def query(spark, sf_dir):
    from lateline.llm.common import table

    packed = pieces(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
