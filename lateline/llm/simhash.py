"""SimHash near-duplicates found through Golay codewords.

Fingerprints of 64 bits are cut into three segments of at most 23 bits. The
perfect binary Golay code [23, 12] gives each segment the index of its nearest
codeword (at most 3 bits away) and the indices of all codewords at most 4 bits
away, one or six in all. Two segments that differ in one bit share the nearest
codeword of the one and a near codeword of the other; two that differ in two bits
share a near codeword.

Where fingerprints differ in at most four bits, the errors fall on the three
segments such that either two segments have at most one error each (keys of two
indices: nearest of one and near of the other, one way round on each side of the
join), or one has none and the other two have two each (key of the exact segment
and a near index of the next one). Pairs that share a key are verified bit by bit.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lateline.llm.common import byte_values, map_batches
from lateline.llm.components import components
from lateline.sources.staging import settle

SHINGLE, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, width
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_CHUNK = 1 << 16

# ---- fingerprints ------------------------------------------------------------


def fingerprint(text, width=SHINGLE):
    """The SimHash of a text given as UTF-8 bytes, as an unsigned integer.

    A-Z are lower-cased; words are parted by ASCII white space. Every shingle of
    `width` words counts, repeats included; a shorter text is one shingle, one
    without words (or None) has fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    reach = min(width, len(words)) - 1
    starts, ends = (ends - lengths)[: len(words) - reach], ends[reach:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        cuts = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in cuts], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs):
    """(doc_id, fp) for every row of `docs`; fp is the fingerprint's bits as a signed long."""

    def batch_of(batch):
        found = np.fromiter(map(fingerprint, byte_values(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs, batch_of, "doc_id long, fp long")


# ---- Golay code --------------------------------------------------------------


def _remainders():
    """For each 12-bit data word, its 11 check bits."""
    table = np.zeros(1 << 12, np.int64)
    for data in range(1 << 12):
        rest = data << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        table[data] = rest
    return table


def _error_patterns(remainders):
    """By syndrome: the error patterns of weight 4 or less, lightest first, and how many there are."""
    from itertools import combinations

    patterns, count = np.zeros((1 << 11, 6), np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << bit for bit in bits)
            syndrome = (error & 0x7FF) ^ remainders[error >> 11]
            if weight < 4 or 0 < count[syndrome] and patterns[syndrome, 0].item().bit_count() == 3:
                patterns[syndrome, count[syndrome]] = error
                count[syndrome] += 1
    return patterns, count


class Golay:
    """Decoder for many 23-bit words at a time."""

    def __init__(self):
        self.remainders = _remainders()
        self.patterns, self.count = _error_patterns(self.remainders)

    def near(self, words):
        """Indices of all codewords at most 4 bits away, nearest first (n x 6), and how many each word has."""
        syndromes = (words & 0x7FF) ^ self.remainders[words >> 11]
        return (words[:, None] ^ self.patterns[syndromes]) >> 11, self.count[syndromes]


_golay = None


def golay():
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


# ---- keys --------------------------------------------------------------------


def candidate_keys(values, side):
    """(row, key) arrays for unsigned fingerprints; a left key meets a right key within MAX_BITS errors."""
    parts = [((values >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near, count = zip(*(golay().near(part) for part in parts), strict=True)
    used = [np.arange(6)[None, :] < n[:, None] for n in count]
    rows, keys = [], []

    def emit(family, first, second, bits, mask):
        row, slot = np.nonzero(mask)
        key = (np.int64(family) << 40) | (first[row, slot] << bits) | second[row, slot]
        rows.append(row)
        keys.append(key)

    wide = lambda column: np.broadcast_to(column[:, None], (len(values), 6))
    for family, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        if side == "left":
            emit(family, wide(near[x][:, 0]), near[y], 12, used[y])
        else:
            emit(family, near[x], wide(near[y][:, 0]), 12, used[x])
    for x in range(3):
        y = (x + 1) % 3
        emit(3 + x, wide(parts[x]), near[y], 12, used[y])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(classes, side):
    def batch_of(batch):
        values = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = candidate_keys(values.view(np.uint64), side)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], ["key", side])

    return map_batches(classes.select("fp"), batch_of, f"key long, {side} long")


# ---- near-duplicates ---------------------------------------------------------


def linked_fingerprints(classes):
    """(left, right) of all distinct fingerprints in column fp that differ in at most MAX_BITS bits.

    A pair is reported under the first family of keys that its errors allow, so
    sharing several keys does not multiply it.

    Spark sizes the keys by the fingerprints they are made from, 48 times too low: it
    would send them all to the driver as a broadcast. So their join is always shuffled.
    """
    pairs = _keyed(classes, "left").hint("merge").join(_keyed(classes, "right"), "key")
    apart = F.col("left").bitwiseXOR(F.col("right"))
    errors = [F.bit_count(F.shiftrightunsigned(apart, low).bitwiseAND((1 << width) - 1)) for low, width in SEGMENTS]
    family = F.shiftright("key", 40)
    few = [count <= 1 for count in errors]
    allowed = (family == 0) & few[0] & few[1]
    allowed = allowed | ((family == 1) & few[0] & few[2] & ~few[1])
    allowed = allowed | ((family == 2) & few[1] & few[2] & ~few[0])
    for x in range(3):
        exact = (errors[x] == 0) & (errors[(x + 1) % 3] == 2) & (errors[(x + 2) % 3] == 2)
        allowed = allowed | ((family == 3 + x) & exact)
    close = F.bit_count(apart) <= MAX_BITS
    return pairs.where((F.col("left") < F.col("right")) & close & allowed).select("left", "right")


def near_duplicates(docs):
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    Copies collapse to one fingerprint before any search, so a group of copies of
    any size costs one key set. component_id is the smallest doc_id that links
    reach; rows without doc_id are fingerprinted and link, but give no component
    its name. Repeated rows stay. An empty table gives an empty one.
    """
    marked = settle(fingerprints(docs), "fingerprints")
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(linked_fingerprints(classes))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = settle(named.join(smallest, "component").select("fp", "component_id"), "named")
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def query(spark, sf_dir):
    from lateline.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
