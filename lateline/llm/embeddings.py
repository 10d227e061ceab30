"""Embedding near-duplicates by an epsilon grid order join.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c), the
join's epsilon. Vectors are projected onto their leading principal axes, put into
grid cells of width epsilon, and sorted by cell, axis by axis. The sorted sequence
is cut into intervals of INTERVAL vectors. Two intervals are joined if their cells
on the first axis are neighbours and the boxes around their projections are no
farther apart than epsilon; inside a task both are halved recursively, again
skipping what is provably distant, down to tiles that one matrix product settles.

The join is exact, the axes only decide what is skipped. A tile reports how many
links each vector has and a star per group of linked vectors, never the pairs, so
a group of copies costs rows in proportion to its size. Where vectors do not
cluster on any axis nothing can be skipped and the work is that of all tiles.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline.llm.common import map_batches
from lateline.llm.components import components
from lateline.sources.staging import settle

COSINE = 0.9
AXES = 6
INTERVAL, TILE = 4096, 512
FIT_ROWS = 20_000  # expected number of vectors the axes are fitted on; they bear on speed alone
_SLACK = 1e-9  # rounding of projections
_ROUGH = 1e-4  # more than single precision can err on a cosine

# ---- vectors -----------------------------------------------------------------


def _usable(embedding):
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column):
    """The vectors of a list column of one length as unit vectors in double precision."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return _unit(rows)


def _unit(rows):
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no square under- or overflows
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _by_length(batch):
    """The rows of a batch grouped by their vectors' length."""
    lengths = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield int(length), batch.take(pa.array(np.flatnonzero(lengths == length)))


# ---- axes --------------------------------------------------------------------


def principal_axes(vectors, axes=AXES, fit_rows=FIT_ROWS):
    """{length: leading principal axes} of the most frequent vector lengths, from a bounded hash sample.

    Only second moments leave the executors, as many numbers as a vector's length squared.
    """
    total = vectors.count()
    if not total:
        return {}
    share = int(min(1.0, fit_rows / total) * 1_000_000)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)

    def moments(batches):
        sums = {}
        for batch in batches:
            for length, part in _by_length(batch):
                rows = _matrix(part.column("embedding"))
                sums[length] = sums.get(length, 0) + rows.T @ rows
        for length, square in sums.items():
            i, j = np.divmod(np.arange(length * length, dtype=np.int64), length)
            columns = [np.full(length * length, length, np.int64), i, j, square.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "i", "j", "value"])

    lengths = [r["length"] for r in vectors.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(4).collect()]
    sums = sample.where(F.size("embedding").isin(lengths)).select("embedding").mapInArrow(moments, "length long, i long, j long, value double")
    square = {}
    for row in sums.groupBy("length", "i", "j").agg(F.sum("value").alias("value")).collect():
        square.setdefault(row["length"], np.zeros((row["length"],) * 2))[row["i"], row["j"]] = row["value"]
    return {length: np.linalg.eigh(moment)[1][:, ::-1][:, :axes].T.copy() for length, moment in square.items()}


def _project(rows, found):
    """Projections onto the axes of these vectors' length; onto the first coordinates if none were fitted."""
    axes = found.get(rows.shape[1])
    projected = rows @ axes.T if axes is not None else rows[:, :AXES]
    out = np.zeros((len(rows), AXES))
    out[:, : projected.shape[1]] = projected
    return out


# ---- sequence ----------------------------------------------------------------


def grid_sequence(vectors, axes, epsilon):
    """Vectors in epsilon grid order, cut into intervals: (length, part, vec_id, embedding)."""
    names = [f"c{i}" for i in range(AXES)]

    def cells(batch):
        for length, part in _by_length(batch):
            grid = np.floor(_project(_matrix(part.column("embedding")), axes) / epsilon).astype(np.int32)
            columns = [part.column("vec_id"), part.column("embedding"), pa.array(np.full(len(grid), length, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(grid[:, i]) for i in range(AXES)]], ["vec_id", "embedding", "length", *names])

    element = vectors.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, embedding {element}, length int, " + ", ".join(f"{name} int" for name in names)
    order = ["length", *names, "vec_id"]
    ordered = map_batches(vectors, cells, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    # a row's number holds its partition and its place there
    ordered = settle(ordered.select("vec_id", "embedding", "length", F.monotonically_increasing_id().alias("row")), "sequence")
    ordered = ordered.withColumns({"slice": F.shiftright("row", 33), "place": F.col("row").bitwiseAND((1 << 33) - 1)})
    sizes = ordered.groupBy("length", "slice").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slice", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ordered.join(sizes, ["length", "slice"])
    part = F.floor((F.col("place") - F.col("first") + F.col("before")) / INTERVAL)
    return placed.select("length", part.alias("part"), "vec_id", "embedding")


_INTERVAL = "length int, part long, ids binary, vectors binary, low array<double>, high array<double>"


def intervals(sequence, axes):
    """One row per interval: its ids and unit vectors, and the box around its projections."""

    def gather(table):
        length, part = table.column("length")[0], table.column("part")[0]
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that the smallest row number is the smallest id
        rows = _matrix(table.column("embedding").combine_chunks())
        projected = _project(rows, axes)
        order = order[np.lexsort(np.floor(projected[order][:, ::-1]).T)] if len(order) else order
        names = [field.split(" ")[0] for field in _INTERVAL.split(", ")]
        values = [[length.as_py()], [part.as_py()], [ids[order].tobytes()], [rows[order].tobytes()], [projected.min(0).tolist()], [projected.max(0).tolist()]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return sequence.groupBy("length", "part").applyInArrow(gather, _INTERVAL)


def interval_pairs(parts, epsilon):
    """(length, one, other) of all intervals that may hold a link between them, each pair once."""
    cell = lambda column: F.floor(F.get(column, F.lit(0)) / epsilon)
    boxes = parts.select("length", "part", "low", "high", cell("low").alias("first"), cell("high").alias("last"))
    one = boxes.select("length", F.col("part").alias("one"), F.col("low").alias("one_low"), F.col("high").alias("one_high"),
                       (F.col("first") - 1).alias("from"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"))
    other = boxes.select("length", F.col("part").alias("other"), "low", "high", "first", F.explode(F.sequence("first", "last")).alias("cell"))
    met = one.join(other, ["length", "cell"])
    gap = F.transform(F.arrays_zip("one_low", "one_high", "low", "high"), lambda x: F.greatest(F.lit(0.0), x["one_low"] - x["high"], x["low"] - x["one_high"]))
    distance = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x)
    once = F.col("cell") == F.greatest("from", "first")  # the first cell the two share
    met = met.where(once & (F.col("one") <= F.col("other")) & (distance <= (epsilon + _SLACK) ** 2))
    # which side leads alternates, so no interval leads most of its pairs
    swap = (F.col("one") + F.col("other")) % 2 == 1
    return met.select("length", F.when(swap, F.col("other")).otherwise(F.col("one")).alias("one"), F.when(swap, F.col("one")).otherwise(F.col("other")).alias("other"))


# ---- joining two intervals -----------------------------------------------------


def _tile_stars(mask, rows, columns):
    """Edges that tie each group linked inside a tile to its smallest number."""
    big = np.iinfo(np.int64).max
    left, right = rows.copy(), columns.copy()
    while True:
        down = np.minimum(right, np.where(mask, left[:, None], big).min(0))
        across = np.minimum(left, np.where(mask, down[None, :], big).min(1))
        if (down == right).all() and (across == left).all():
            break
        left, right = across, down
    return np.concatenate([rows, columns]), np.concatenate([left, right])


def smallest_linked(n, a, b):
    """For each of n numbers, the smallest one that the edges a-b reach from it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _halves(start, end):
    if end - start <= TILE:
        return [(start, end)]
    middle = start + max(TILE, (end - start) // 2 // TILE * TILE)
    return [(start, middle), (middle, end)]


def join_intervals(left, right, axes, cosine=COSINE):
    """Links between two intervals of unit vectors, or inside one if `right` is None.

    Returns each vector's number of links and the smallest number it is tied to;
    the right interval's vectors are numbered after the left one's.
    """
    epsilon = np.sqrt(2 - 2 * cosine) + _SLACK
    same = right is None
    right = left if same else right
    base = 0 if same else len(left)
    n = len(left) + (0 if same else len(right))
    where = [_project(left, axes), _project(right, axes)]
    rough = [left.astype(np.float32), right.astype(np.float32)]
    links, edges = np.zeros(n, np.int64), []

    def tile(a, b, c, d):
        if (rough[0][a:b] @ rough[1][c:d].T).max() < cosine - _ROUGH:
            return
        mask = left[a:b] @ right[c:d].T >= cosine
        if same and a == c:
            np.fill_diagonal(mask, False)
        if not mask.any():
            return
        links[a:b] += mask.sum(1)
        if not (same and a == c):
            links[base + c : base + d] += mask.sum(0)
        edges.append(_tile_stars(mask, np.arange(a, b), np.arange(base + c, base + d)))

    def descend(a, b, c, d):
        if same and c < a:
            return
        one, other = where[0][a:b], where[1][c:d]
        gap = np.maximum(0, np.maximum(one.min(0) - other.max(0), other.min(0) - one.max(0)))
        if gap @ gap > epsilon * epsilon:
            return
        if b - a <= TILE and d - c <= TILE:
            tile(a, b, c, d)
            return
        for x in _halves(a, b):
            for y in _halves(c, d):
                descend(*x, *y)

    if len(left) and len(right):
        descend(0, len(left), 0, len(right))
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    return links, smallest_linked(n, a, b)


def _linked_rows(axes, cosine):
    def batch_of(batch):
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i in range(batch.num_rows):
            width = columns["length"][i]
            ids = [np.frombuffer(columns[name][i], np.int64) for name in ("ids", "other_ids")]
            rows = [np.frombuffer(columns[name][i], np.float64).reshape(-1, width) for name in ("vectors", "other_vectors")]
            same = columns["one"][i] == columns["other"][i]
            links, label = join_intervals(rows[0], None if same else rows[1], axes, cosine)
            every = ids[0] if same else np.concatenate(ids)
            smallest = every.copy()
            np.minimum.at(smallest, label, every)
            found = np.flatnonzero(links)
            arrays = [pa.array(every[found]), pa.array(links[found]), pa.array(smallest[label][found])]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "n", "tied"])

    return batch_of


# ---- near-duplicates ---------------------------------------------------------


def near_duplicates(embeddings, cosine=COSINE):
    """(vec_id, n_links, component_id, kept) for every vec_id of `embeddings` (vec_id, embedding).

    Vectors of one length are compared, whatever other columns say. A vector that
    is null, zero, or holds a null or a number that is not finite links with
    nothing, and so does a row without vec_id. Rows with the same vec_id are one
    vector, the largest of theirs. An empty table gives an empty one.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    nameless = rows.where("vec_id IS NULL").select("vec_id")
    rows = settle(rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.max("embedding").alias("embedding")), "vectors")
    usable = rows.where(_usable(F.col("embedding")))
    axes = principal_axes(usable)
    parts = settle(intervals(grid_sequence(usable, axes, epsilon), axes), "intervals")
    one = parts.select("length", F.col("part").alias("one"), "ids", "vectors")
    other = parts.select("length", F.col("part").alias("other"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    joined = interval_pairs(parts, epsilon).join(one, ["length", "one"]).join(other, ["length", "other"])
    found = settle(map_batches(joined, _linked_rows(axes, cosine), "vec_id long, n long, tied long"), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    named = components(found.select("vec_id", "tied")).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    every = rows.select("vec_id").join(counts, "vec_id", "left").join(named, "vec_id", "left").unionByName(nameless, allowMissingColumns=True)
    return every.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def query(spark, sf_dir):
    from lateline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(n.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(n.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN named n ON e.vec_id = n.a
"""
