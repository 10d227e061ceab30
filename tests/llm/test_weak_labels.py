"""Label model, scorer, and agreement with labels nobody showed them."""

import math
import os
import random
import re
import unicodedata
import zlib
from itertools import groupby, pairwise

import numpy as np
import pytest

from lateline.llm import weak_labels

SCHEMA = "doc_id long, text string, p_bad string, kept int"
SF = "/root/testdata/sf0.01"


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, size = 40_000, len(weak_labels.HEURISTICS)
    accuracies = np.linspace(0.7, 0.95, size)
    bad = rng.random(n) < 0.2
    right = rng.random((n, size)) < accuracies
    found = np.where(rng.random((n, size)) < 0.3, "-", np.where(right == bad[:, None], "b", "g"))
    patterns, counts = np.unique(found, axis=0, return_counts=True)
    counts = {"".join(p): int(c) for p, c in zip(patterns, counts, strict=True)}
    model = weak_labels.fit_labels(counts)
    assert abs(model.prior - 0.2) < 0.02 and np.abs(model.accuracies - accuracies).max() < 0.02
    posterior = dict(zip(counts, model.posterior(list(counts)), strict=True))
    judged = np.array([posterior["".join(p)] > 0.5 for p in found])
    assert (judged == bad).mean() > 0.95


def test_shapes():
    assert [weak_labels.shape(w) for w in ("Hello,", "ABC!!!", "x9x", "|", "\u00c9t\u00e9")] == ["Aa,", "A!!", "a0a", "|", "Aa"]


def test_long_words_and_texts_are_read_whole():
    for word in ("a" * 64 + "#$%&*|<>", "#$%&*|<>" + "a" * 64):
        assert weak_labels.observe(f"{word} one two")[0]["symbols"] == pytest.approx(1 / 3)
    signs = "-a" * 40
    assert weak_labels.shape(signs) != weak_labels.shape(signs + "0") != weak_labels.shape(signs * 50)
    assert weak_labels.observe("word" + "?!" * 300)[1].tolist() != weak_labels.observe("word" + "?!" * 300 + ";")[1].tolist()
    rich, poor = [f"w{i}" for i in range(500)], ["w"] * 500
    assert [weak_labels.observe(" ".join(t))[0]["distinct"] for t in (rich, poor, rich + poor, poor + rich, rich * 40)] == [1, 0.002, 0.501, 0.501, 1]


def plain_shape(word):
    kinds = "".join("A" if (k := unicodedata.category(c)) == "Lu" else "a" if k[0] == "L" else "0" if k[0] == "N" else c for c in word)
    runs = [(c, len(list(run))) for c, run in groupby(kinds)]
    found = "".join(c if c in "Aa0" else c * min(n, 2) for c, n in runs)
    return found if len(found) <= 12 else "".join(sorted(set(found))) + ":" + str(len(found).bit_length())


def plain_features(text):
    words = (text or "").split()
    n, features = len(words), {}
    seen = dict.fromkeys(("caps", "bangs", "symbols", "bars", "plain"), 0)
    for word in words:
        core = word.rstrip(".,;:?!")
        ends = "".join(c * min(len(list(run)), 2) for c, run in groupby(word[len(core) :]))
        ends = ends if len(ends) <= 3 else "".join(sorted(set(ends)))
        form = plain_shape(core)
        if core.isalpha():
            form = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[0].isupper() and core[1:].islower() else form
        features[zlib.crc32((form + ends).encode()) % 4096] = features.get(zlib.crc32((form + ends).encode()) % 4096, 0) + 1
        caps = len(word) > 1 and word.isupper()
        seen["caps"] += caps
        seen["bangs"] += word.endswith("!!")
        seen["symbols"] += not core.isalpha() and sum(c in "#*$%&|<>~^@=_+\\{}[]" for c in core) >= 2
        seen["bars"] += word == "|"
        seen["plain"] += core.isalpha() and len(ends) < 2 and not caps
    m = {k: v / n if n else 0 for k, v in seen.items()}
    repeats = sum(a == b for a, b in pairwise(words)) / n if n else 0
    distinct = sum(len(set(words[i : i + 500])) for i in range(0, n, 500)) / n if n else 0
    sentences = len(re.findall(r"[a-z][.!?]\s+[A-Z]", text or "")) / n if n else 0
    rows = [(k, math.sqrt(v / n)) for k, v in features.items()]
    marks = ((f"words:{n.bit_length()}", 0.3), (f"repeats:{min(9, int(10 * repeats))}", 1.0), (f"distinct:{min(5, int(5 * distinct))}", 0.3))
    rows += [(zlib.crc32(name.encode()) % 4096, value) for name, value in marks]
    votes = [m["caps"] >= 0.3, m["bangs"] >= 0.2, m["symbols"] >= 0.2, m["bars"] >= 0.15, n >= 10 and repeats >= 0.2, n >= 20 and distinct < 0.25]
    votes = ["b" if n and v else "-" for v in votes]
    prose = m["plain"] - repeats
    votes += ["g" if prose >= 0.85 else "b" if prose < 0.65 and n >= 15 else "-"]
    return "".join(votes + ["g" if n >= 20 and sentences - repeats >= 0.05 else "-"]), rows


def plain_posteriors(votes):
    """EM over documents, one at a time."""

    def posterior(v):
        odds = math.log(prior / (1 - prior)) + sum({"b": 1, "g": -1, "-": 0}[x] * math.log(a / (1 - a)) for x, a in zip(v, accuracies, strict=True))
        return 1 / (1 + math.exp(-odds))

    prior, accuracies, own = 0.1, [0.85] * 8, 10 + 0.02 * len(votes)
    for _ in range(200):
        bad = [posterior(v) for v in votes]
        new = []
        for h in range(8):
            right = sum(b if v[h] == "b" else 1 - b if v[h] == "g" else 0 for v, b in zip(votes, bad, strict=True))
            new.append(min(0.97, max(0.5, (right + 0.85 * own) / (sum(v[h] != "-" for v in votes) + own))))
        before = prior
        prior = min(0.999, max(0.001, (sum(bad) + 1) / (len(votes) + 10)))
        moved = abs(prior - before) + max(abs(a - b) for a, b in zip(new, accuracies, strict=True))
        accuracies = new
        if moved < 1e-9:
            break
    return [posterior(v) for v in votes]


def plain_scores(texts):
    """Votes, posteriors and scores of all texts, everything written out in loops."""
    seen = [plain_features(t) for t in texts]
    bad = plain_posteriors([v for v, _ in seen])
    fitted = {}  # one of each group of equal rows is fitted
    for (votes, rows), p in zip(seen, bad, strict=True):
        merged = tuple(sorted((k, round(v, 12)) for k, v in rows))
        fitted[votes, merged] = (rows, p)
    fitted = list(fitted.values())
    mean = sum(p for _, p in fitted) / len(fitted)
    weights, slope, square = {}, {}, {}
    for step in range(1, 301):
        gradient = {k: 1e-4 * w for k, w in weights.items()}
        for rows, p in fitted:
            rows = rows + [("bias", 1.0)]
            score = sum(v * weights.get(k, 0.0) for k, v in rows)
            balance = 0.5 / max(mean, 0.02) if p >= 0.5 else 0.5 / max(1 - mean, 0.02)
            error = balance * (1 / (1 + math.exp(-max(-30, min(30, score)))) - p) / len(fitted)
            for k, v in rows:
                gradient[k] = gradient.get(k, 0.0) + v * error
        for k, g in gradient.items():
            slope[k] = 0.9 * slope.get(k, 0.0) + 0.1 * g
            square[k] = 0.99 * square.get(k, 0.0) + 0.01 * g * g
            weights[k] = weights.get(k, 0.0) - 0.2 * (slope[k] / (1 - 0.9**step)) / (math.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    scores = [sum(v * weights.get(k, 0.0) for k, v in rows + [("bias", 1.0)]) for _, rows in seen]
    return [(v, b, 1 / (1 + math.exp(-max(-30, min(30, s))))) for (v, _), b, s in zip(seen, bad, scores, strict=True)]


def test_query_against_plain_version(spark, tmp_path):
    rng, texts = random.Random(4), [None, "", "a" * 64 + "#$%&*|<>", "x" * 3000, "-a" * 500 + "?!;" * 9]
    plain, junk = "the quick brown fox jumped over a lazy dog and Then it did so twice".split(), "BUY NOW!! ### $$$ | <a> x9x !!! 12:30".split()
    for i in range(40):
        words = rng.choices(plain if i % 3 else junk, k=rng.choice((5, 30, 120, 1300)))
        texts += [" ".join(w + rng.choice((" ", ". ", "")) if not j % 9 else w for j, w in enumerate(words)).replace(". t", ". T")]
    texts += texts[5:8]
    spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in weak_labels.query(spark, str(tmp_path)).collect()}
    want = plain_scores(texts)
    assert [got[i]["votes"] for i in range(len(texts))] == [v for v, _, _ in want]
    assert [got[i]["p_label"] for i in range(len(texts))] == pytest.approx([b for _, b, _ in want], abs=1e-9)
    assert [got[i]["p_bad"] for i in range(len(texts))] == pytest.approx([s for _, _, s in want], abs=1e-6)


def test_scorer_learns_from_soft_labels():
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        bad = rng.random() < 0.3
        text = " ".join("WORD!!" if bad else "word" for _ in range(50))
        _, buckets, values = weak_labels.observe(text)
        rows.append((buckets, values, 0.95 if bad else 0.05))
    weights = weak_labels.fit_scorer(rows)
    assert weak_labels.score_of("WORD!! " * 40, weights) > 0.5 > weak_labels.score_of("word " * 40 + "word", weights)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_agreement_with_held_out_labels(spark):
    judged = weak_labels.query(spark, SF).select("doc_id", "kept")
    rows = judged.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows)
    kept = [r["kept"] for r in rows if r["quality"]]
    assert right >= 0.95 and sum(kept) >= 0.99 * len(kept)


def test_odd_rows_and_repeats(spark, tmp_path):
    good = "The quick brown fox, as ever, jumped over a lazy dog. It did so twice. "
    rows = [(i, " ".join(random.Random(i).sample(good.split() * 8, 100)), "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (101, "", None, None), (102, " \n", "x", 1), (None, good * 3, "x", 1), (0, rows[0][1], "x", 1), (103, "word " * 100_000, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = weak_labels.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["p_bad"] <= 1 and r["kept"] == (r["p_bad"] < 0.5) for r in got)
    assert len({r["p_bad"] for r in got if r["doc_id"] == 0}) == 1
    kept = weak_labels.judge(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert kept.columns == ["doc_id", "text", "p_bad", "kept"] and kept.count() == len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert weak_labels.query(spark, str(tmp_path)).count() == 0
