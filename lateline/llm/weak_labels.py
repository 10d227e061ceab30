"""Quality classifier without labels: heuristics vote, EM weighs them, a linear scorer learns the outcome.

Overlapping heuristics each call a document good or bad or abstain. The only thing
counted over the corpus is how often each pattern of votes occurs, at most three to
the number of heuristics rows. Expectation-maximisation over these counts gives
every heuristic its rates of each vote on good and on bad documents, without
assuming that any of them is right, and every pattern its posterior. A logistic
scorer over hashed word shapes is then fitted to posteriors of a bounded sample of
documents and judges all of them, also where the heuristics abstain.
"""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F

BUCKETS = 4096
FIT_DOCUMENTS = 8_000  # expected number of documents the scorer is fitted on
THRESHOLD = 0.5
EM_ROUNDS = 200
_REMEMBERED, _REMEMBERED_LETTERS = 100_000, 4_000_000
_WINDOW = 500  # words within which repeats lower a text's variety

# ---- what is seen in a text ----------------------------------------------------

_UPPER, _OTHER = regex.compile(r"\p{Lu}+"), regex.compile(r"(?:(?!A)\p{L})+")
_DIGITS, _REPEATS = regex.compile(r"\p{N}+"), regex.compile(r"(.)\1+")
_SYMBOLS = frozenset("#*$%&|<>~^@=_+\\{}[]")
_CLOSING = ".,;:?!"
_SENTENCE = regex.compile(r"\p{Ll}[.!?]\s+\p{Lu}").findall  # one ends and the next begins


def shape(word):
    """A word with runs of capitals as A, of other letters as a, of digits as 0, and repeated signs cut to two.

    A shape of more than twelve signs is told by which signs it holds and how long it is, to a power of two.
    """
    found = _squeezed(_DIGITS.sub("0", _OTHER.sub("a", _UPPER.sub("A", word))))
    return found if len(found) <= 12 else f"{''.join(sorted(set(found)))}:{len(found).bit_length()}"


def _squeezed(signs):
    return _REPEATS.sub(r"\1\1", signs)


class _Looks(dict):
    """Word to a number for how it looks; `table` has by number: hash bucket of the shape, capitals, bangs, symbols, bar, plain."""

    def __init__(self):
        super().__init__()
        self.letters = 0
        self._forget()

    def _forget(self):
        self.clear()
        self.letters, self.kinds, self.rows, self.table = 0, {}, [], np.zeros((0, 6))

    def __missing__(self, word):
        core = word.rstrip(_CLOSING)
        ends = word[len(core) :]
        if len(ends) > 2:
            ends = _squeezed(ends)
            ends = ends if len(ends) <= 3 else "".join(sorted(set(ends)))
        if core.isalpha():
            form = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[0].isupper() and core[1:].islower() else shape(core)
            symbols = False
        else:
            form, symbols = shape(core), sum(c in _SYMBOLS for c in core) >= 2
        kind = (form, ends, len(word) > 1 and word.isupper(), word.endswith("!!"), symbols, word == "|", core.isalpha() and len(ends) < 2 and not (len(word) > 1 and word.isupper()))
        number = self.kinds.get(kind)
        if number is None:
            number = self.kinds[kind] = len(self.rows)
            bucket = zlib.crc32((form + ends).encode()) % BUCKETS
            self.rows.append((bucket, *map(float, kind[2:])))
        self[word] = number
        self.letters += len(word)
        return number

    def of(self, words):
        if len(self) > _REMEMBERED or self.letters > _REMEMBERED_LETTERS:
            self._forget()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        return self.table[numbers].reshape(-1, 6)


_looks = _Looks()


def observe(text):
    """Measurements of a text and its hashed features: (measures, buckets, values). All of it is read, long words too."""
    words = (text or "").split()
    n = len(words)
    counts = Counter(words)
    seen = _looks.of(counts)
    times = np.fromiter(counts.values(), np.float64, len(counts))
    shares = (times @ seen[:, 1:]) / n if n else np.zeros(5)
    repeats = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
    measures = dict(zip(("caps", "bangs", "symbols", "bars", "plain"), shares.tolist(), strict=True), n=n, repeats=repeats)
    measures["sentences"] = len(_SENTENCE(text)) / n if n else 0.0
    # over windows of all its words: long texts repeat words, that does not make them poor
    windows = [counts] if n <= _WINDOW else (set(words[i : i + _WINDOW]) for i in range(0, n, _WINDOW))
    measures["distinct"] = sum(map(len, windows)) / n if n else 0.0
    buckets, place = np.unique(seen[:, 0].astype(np.int64), return_inverse=True)
    values = np.bincount(place, times, len(buckets)) / n if n else np.zeros(0)
    marks = {f"words:{n.bit_length()}": 0.3, f"repeats:{min(9, int(10 * repeats))}": 1.0, f"distinct:{min(5, int(5 * measures['distinct']))}": 0.3}
    extra = np.array([zlib.crc32(name.encode()) % BUCKETS for name in marks])
    return measures, np.concatenate([buckets, extra]), np.concatenate([np.sqrt(values), list(marks.values())])


# ---- heuristics --------------------------------------------------------------

GOOD, BAD, ABSTAIN = "g", "b", "-"


def _bad_from(name, share, least=1):
    """Bad from a share of the words on; no vote below it, or on fewer words."""
    return lambda m: BAD if m["n"] >= least and m[name] >= share else ABSTAIN


def _prose(m):
    """Plain words that do not repeat the one before: good where nearly all are, bad where many of 15 or more are not."""
    share = m["plain"] - m["repeats"]
    return GOOD if share >= 0.85 else BAD if share < 0.65 and m["n"] >= 15 else ABSTAIN


HEURISTICS = {
    "capitals": _bad_from("caps", 0.3),
    "bangs": _bad_from("bangs", 0.2),
    "symbols": _bad_from("symbols", 0.2),
    "bars": _bad_from("bars", 0.15),
    "repeats": _bad_from("repeats", 0.2, 10),
    "variety": lambda m: BAD if m["n"] >= 20 and m["distinct"] < 0.25 else ABSTAIN,
    "prose": _prose,
    "sentences": lambda m: GOOD if m["n"] >= 20 and m["sentences"] - m["repeats"] >= 0.05 else ABSTAIN,
}


def votes_of(measures):
    return "".join(vote(measures) for vote in HEURISTICS.values())


def votes(docs):
    """`docs` with their pattern of votes, one letter per heuristic, as column `votes`."""

    @F.pandas_udf("string")
    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: votes_of(observe(text)[0]))

    return docs.withColumn("votes", of_texts(F.coalesce(F.col("text").cast("string"), F.lit(""))))


# ---- expectation-maximisation --------------------------------------------------


class LabelModel:
    """The share of bad documents, and how often each heuristic is right when it votes."""

    def __init__(self, prior, accuracies):
        self.prior, self.accuracies = prior, accuracies

    def posterior(self, patterns):
        """Probability of being bad for each pattern of votes; who abstains says nothing."""
        weight = np.log(self.accuracies / (1 - self.accuracies))
        score = np.log(self.prior / (1 - self.prior)) + _signs(patterns) @ weight
        return 1 / (1 + np.exp(-score))


def _signs(patterns):
    """1 for a vote for bad, -1 for good, 0 for none; pattern by heuristic."""
    value = {GOOD: -1.0, BAD: 1.0, ABSTAIN: 0.0}
    return np.array([[value[v] for v in pattern] for pattern in patterns]).reshape(len(patterns), len(HEURISTICS))


def fit_labels(counts, rounds=EM_ROUNDS):
    """A LabelModel from {pattern of votes: documents with it}.

    All heuristics start as equally good ones. Votes of that quality, two in a
    hundred documents, are added to each one's own, so one that hardly votes stays
    near it; none is taken to be right nearly always, so no single one outvotes all.
    """
    start, most = 0.85, 0.97
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    own = 10 + 0.02 * n.sum()
    model = LabelModel(0.1, np.full(len(HEURISTICS), start))
    if not patterns:
        return model
    signs = _signs(patterns)
    for _ in range(rounds):
        bad = model.posterior(patterns)
        right = np.where(signs > 0, bad[:, None], np.where(signs < 0, 1 - bad[:, None], 0))
        accuracies = (n @ right + start * own) / (n @ np.abs(signs) + own)
        accuracies = np.clip(accuracies, 0.5, most)
        prior = float(np.clip((n @ bad + 1) / (n.sum() + 10), 0.001, 0.999))
        moved = abs(prior - model.prior) + np.abs(accuracies - model.accuracies).max()
        model = LabelModel(prior, accuracies)
        if moved < 1e-9:
            break
    return model


# ---- linear scorer -------------------------------------------------------------


def fit_scorer(rows, rounds=300, penalty=1e-4):
    """Weights of a logistic scorer from [(buckets, values, probability of being bad)]."""
    weights, slope, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not rows:
        weights[-1] = -10.0
        return weights
    index = np.concatenate([np.append(r[0], BUCKETS) for r in rows]).astype(np.int64)
    value = np.concatenate([np.append(r[1], 1.0) for r in rows])
    sizes = np.array([len(r[0]) + 1 for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    target = np.array([r[2] for r in rows])
    balance = np.where(target >= 0.5, 0.5 / max(target.mean(), 0.02), 0.5 / max(1 - target.mean(), 0.02))
    for step in range(1, rounds + 1):
        score = np.add.reduceat(value * weights[index], starts)
        error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / len(rows)
        gradient = np.bincount(index, value * error[row], BUCKETS + 1) + penalty * weights
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights = weights - 0.2 * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def score_of(text, weights):
    """Probability that a text is of low quality."""
    _, buckets, values = observe(text)
    return float(1 / (1 + np.exp(-np.clip(weights[buckets] @ values + weights[-1], -30, 30))))


class QualityModel:
    """Label model and scorer of one corpus."""

    def __init__(self, labels, weights):
        self.labels, self.weights = labels, weights

    def score(self, docs):
        """`docs` with `p_bad`, the probability that a document is of low quality; a null text is an empty one."""
        weights = self.weights

        @F.pandas_udf("double")
        def of_texts(texts: pd.Series) -> pd.Series:
            return texts.map(lambda text: score_of(text, weights))

        return docs.withColumn("p_bad", of_texts(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def fit(docs, fit_documents=FIT_DOCUMENTS):
    """A QualityModel of `docs` (text): votes of all of them are counted, a bounded sample trains the scorer.

    The sample is drawn by a hash of the text, so copies are in it together or not
    at all, and it is the same in every run. An empty table gives a model that
    calls nothing bad.
    """
    voted = votes(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(counts)
    total = sum(counts.values())
    share = int(1_000_000 * min(1.0, fit_documents / max(total, 1)))
    sample = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one of a group of copies is enough
    sample = sample.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) < share)
    seen = sample.mapInPandas(_observed, "votes string, buckets array<long>, values array<double>").dropDuplicates().collect()
    posterior = dict(zip(counts, labels.posterior(list(counts)), strict=True)) if counts else {}
    rows = [(np.array(r["buckets"]), np.array(r["values"]), posterior[r["votes"]]) for r in sorted(seen, key=lambda r: (r["votes"], r["buckets"], r["values"]))]
    return QualityModel(labels, fit_scorer(rows))


def _observed(frames):
    for frame in frames:
        seen = [observe(text) for text in frame["text"]]
        yield pd.DataFrame({"votes": [votes_of(m) for m, _, _ in seen], "buckets": [b for _, b, _ in seen], "values": [v for _, _, v in seen]})


def judge(docs, model=None, threshold=THRESHOLD):
    """`docs` with `p_bad` and `kept` (p_bad below the threshold); columns of these names are replaced.

    Fits a model on `docs` themselves if none is given. Every row is judged by its
    own text, so repeated rows and missing ids make no difference.
    """
    model = model or fit(docs)
    return model.score(docs.drop("p_bad", "kept")).withColumn("kept", F.col("p_bad") < threshold)


def query(spark, sf_dir):
    """Every document with its votes, the posterior of its pattern, its score and verdict."""
    from lateline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs)
    labels, weights = model.labels, model.weights

    @F.pandas_udf("votes string, p_label double, p_bad double")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        seen = [observe(text) for text in texts]
        patterns = [votes_of(m) for m, _, _ in seen]
        scores = [float(1 / (1 + np.exp(-np.clip(weights[b] @ v + weights[-1], -30, 30)))) for _, b, v in seen]
        return pd.DataFrame({"votes": patterns, "p_label": labels.posterior(patterns), "p_bad": scores})

    judged = docs.select("doc_id", of_texts(F.coalesce("text", F.lit(""))).alias("j")).select("doc_id", "j.*")
    return judged.withColumn("kept", F.col("p_bad") < THRESHOLD)
