"""Epsilon grid join against all pairs."""

import numpy as np
import pytest

from lateline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, part long"


def plain(rows, cosine=0.9):
    largest = {}
    for vec_id, vector, *_ in rows:
        if vec_id is not None:
            largest[vec_id] = vector if largest.get(vec_id) is None else largest[vec_id]
    ids = sorted(largest)
    unit = {}
    for i in ids:
        vector = largest[i]
        if vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            x = np.array(vector, np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x)
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine} if i in unit else set() for i in ids}
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out + [(None, 0, None, True) for r in rows if r[0] is None], key=str)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist(), i % 3, 1) for i in range(150)]
    for i in range(150, 220):
        rows.append((1000 - i, (np.array(rows[i % 20][1]) + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.4])).tolist(), 0, 1))
    hot = rng.normal(size=16)
    rows += [(2000 + i, (hot + rng.normal(size=16) * 0.1).tolist(), 1, 1) for i in range(80)]
    rows += [(3000 + i, rows[i][1], 0, None) for i in range(5)]
    rows += [(4000, None, 0, 0), (4001, [0.0] * 16, 0, 0), (4002, [float("nan")] + [1.0] * 15, 0, 0), (4003, [float("inf")] + [1.0] * 15, 0, 0)]
    rows += [(4004, [None] + [1.0] * 15, 0, 0), (4005, [], 0, 0), (4006, [1.0, 2.0], 0, 0), (4007, [2.0, 4.0], 0, 0), (4008, [1.0] * 16, 0, 0)]
    return rows + [(None, [1.0] * 16, 0, 0), (7, rows[7][1], 5, 5), (4009, [1e-30] * 16, 0, 0)]


@pytest.mark.parametrize("interval, tile", [(4096, 512), (40, 8)])
def test_query(spark, tmp_path, monkeypatch, interval, tile):
    monkeypatch.setattr(embeddings, "INTERVAL", interval)
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vectors()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, embeddings.query(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows) and sum(r[1] for r in got) > 5000


def test_intervals_joined_like_one_product():
    rng = np.random.default_rng(3)
    rows = embeddings._unit(rng.normal(size=(1300, 8)))
    axes = {8: np.linalg.eigh(rows.T @ rows)[1].T[:6]}
    mask = rows @ rows.T >= 0.9
    np.fill_diagonal(mask, False)
    links, label = embeddings.join_intervals(rows, None, axes)
    assert (links == mask.sum(1)).all()
    links, _ = embeddings.join_intervals(rows[:700], rows[700:], axes)
    assert (links == np.r_[mask[:700, 700:].sum(1), mask[:700, 700:].sum(0)]).all()
    assert (label == embeddings.smallest_linked(1300, *np.nonzero(mask))).all()


def test_distant_intervals_are_not_paired(spark):
    low = [[float(x)] * 6 for x in (-0.9, -0.3, 0.4)]
    rows = [(4, i, None, None, a, [x + 0.1 for x in a]) for i, a in enumerate(low)]
    parts = spark.createDataFrame(rows, "length int, part long, ids binary, vectors binary, low array<double>, high array<double>")
    found = sorted(tuple(sorted(r[1:])) for r in embeddings.interval_pairs(parts, 0.447).collect())
    assert found == [(0, 0), (1, 1), (2, 2)]
    wide = sorted(tuple(sorted(r[1:])) for r in embeddings.interval_pairs(parts, 5.0).collect())
    assert wide == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert embeddings.query(spark, str(tmp_path)).count() == 0
