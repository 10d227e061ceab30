"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

Rules name a host and a path; the longest one that fits a URL decides. Where none
does, gradient-boosted trees judge the URL's own characters: lengths, depth, digits,
entropy, parameters, and how often URLs of the same host suffix were bad. Suffix
statistics live in a fixed number of hash buckets, so the table that is joined to
all URLs has a proven bound. They are taken from one half of the labelled URLs and
the trees are grown on the other half, so no tree sees its own label.
"""

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 4096  # of suffix statistics; this many rows at most are broadcast
FIT_URLS = 20_000  # expected number of labelled URLs the trees are fitted on
ROUNDS, DEPTH = 20, 4
PRIOR_WEIGHT = 5.0  # URLs' worth of the overall rate in a suffix's rate

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# hosts with one of these words label a URL as bad, where no labels are at hand
SEED_WORDS = ("spam", "casino", "pills", "adult")

# ---- host and path -----------------------------------------------------------


def host_and_path(urls):
    """`urls` with host and path of column url; both empty where it is null or has no "://".

    The host ends, and the path after it, at the first of / ? # (the path: ? #).
    Only A-Z are lower-cased, in the host alone.
    """
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    urls = urls.drop("host", "path").withColumn("__rest", rest)
    host = F.regexp_extract("__rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("__rest"), F.length(host) + 1, F.length("__rest")), "^[^?#]*", 0)
    return urls.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path}).drop("__rest")


def rule_of(rules=RULES):
    """The longest rule that fits the columns host and path, as struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, path = rule.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


# ---- features ----------------------------------------------------------------

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "longest_label", "digit_ratio", "host_digits",
    "hyphens", "entropy", "parameters", "query_length", "upper_ratio", "escapes", "secure", "suffix_rate", "domain_rate",
)


def _count(text, characters):
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def _entropy(text):
    """Shannon entropy of a text's characters in bits."""
    n = F.length(text).cast("double")

    def part(character):
        share = (n - F.length(F.replace(text, character, F.lit("")))) / n
        return -share * F.log2(share)

    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(letters, part), F.lit(0.0), lambda a, b: a + b)


def _bucket(labels):
    """The hash bucket of a host's last labels."""
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -labels)), F.lit(BUCKETS)).cast("int")


def features(urls):
    """`urls` with host, path, lexical features and the buckets of its suffixes."""
    urls = host_and_path(urls)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    labels = F.split("host", r"\.")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda part: part != "")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda label: F.length(label))).cast("double"),
            "digit_ratio": _count(url, "0123456789") / length,
            "host_digits": _count(F.col("host"), "0123456789"),
            "hyphens": _count(F.col("host"), "-"),
            "entropy": F.when(url == "", F.lit(0.0)).otherwise(_entropy(url)),
            "parameters": F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
            "query_length": F.length(query).cast("double"),
            "upper_ratio": _count(url, UPPER) / length,
            "escapes": _count(url, "%"),
            "secure": F.startswith(F.lower(url), F.lit("https://")).cast("double"),
            "__suffix": _bucket(2),
            "__domain": _bucket(3),
        }
    )


def _rates(labelled, bucket, base):
    rate = (F.sum("bad") + PRIOR_WEIGHT * base) / (F.count("*") + PRIOR_WEIGHT)
    return labelled.groupBy(bucket).agg(rate.alias("rate"))


class UrlModel:
    """Boosted trees and suffix statistics fitted on labelled URLs."""

    def __init__(self, model, rates, base):
        self.model, self.rates, self.base = model, rates, base

    def with_rates(self, urls):
        for (bucket, name), rates in self.rates.items():
            rates = rates.withColumnsRenamed({"rate": name})
            urls = urls.join(F.broadcast(rates), bucket, "left").withColumn(name, F.coalesce(name, F.lit(self.base)))
        return urls

    def is_bad(self, urls):
        """`urls` (with features) with the trees' verdict as boolean column bad."""
        if self.model is None:
            return urls.withColumn("bad", F.lit(False))
        judged = self.model.transform(self.with_rates(urls))
        return judged.withColumn("bad", F.col("prediction") == 1).drop("inputs", "rawPrediction", "probability", "prediction")


def fit(labelled, fit_urls=FIT_URLS, rounds=ROUNDS, depth=DEPTH):
    """A UrlModel from `labelled` (url, bad: 0 or 1); rows with a null in either are left out.

    Suffix rates count all labelled URLs of one half; the trees are fitted on a
    bounded hash sample of the other. Labels of one kind alone, or none, give a
    model that calls nothing bad.
    """
    known = labelled.select("url", F.col("bad").cast("double")).where("url IS NOT NULL AND bad IS NOT NULL")
    spread = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1_000_000))
    known = features(known).withColumn("__at", spread)
    half = known.where("__at < 500000")
    n, base = half.agg(F.count("*"), F.avg("bad")).first()
    grown = known.where("__at >= 500000")
    size, positives = grown.agg(F.count("*"), F.sum("bad")).first()
    if not positives or positives == size:
        return UrlModel(None, {}, 0.0)
    base = base or 0.0
    buckets = (("__suffix", "suffix_rate"), ("__domain", "domain_rate"))
    rates = {(bucket, name): _rates(half, bucket, base) for bucket, name in buckets}
    model = UrlModel(None, rates, base)
    share = 500_000 + int(500_000 * min(1.0, fit_urls / size))
    weight = F.when(F.col("bad") == 1, F.lit(float(size - positives) / positives)).otherwise(1.0)
    train = model.with_rates(grown.where(F.col("__at") < share)).select("bad", weight.alias("weight"), *FEATURES)
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="inputs"),
        GBTClassifier(featuresCol="inputs", labelCol="bad", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=32, seed=1),
    ]
    model.model = Pipeline(stages=stages).fit(train)
    return model


def seed_labels(urls, words=SEED_WORDS):
    """(url, bad) of every URL with a host: bad if the host holds one of the words."""
    hosts = host_and_path(urls.select("url")).where("host <> ''")
    bad = F.lit(False)
    for word in words:
        bad = bad | F.contains("host", F.lit(word))
    return hosts.select("url", bad.cast("int").alias("bad"))


def judge(urls, model, rules=RULES):
    """`urls` with host, path, the deciding rule (null if none), the verdict, allow or block, and what it is by.

    `judged_by` is "rule", "trees", or "default": a model whose labels were all of one
    kind has no trees and allows what no rule fits. Every row is judged, also one with a
    null url. Columns of these names are replaced, others stay whatever their names.
    """
    own = [name for name in urls.columns if name not in ("host", "path", "rule", "verdict", "judged_by")]
    judged = model.is_bad(features(urls.select("url", F.struct(*own).alias("__row"))))
    found = rule_of(rules)
    verdict = F.coalesce(found["verdict"], F.when(F.col("bad"), F.lit("block")).otherwise("allow"))
    judge_of = F.when(found["rule"].isNotNull(), F.lit("rule")).otherwise("default" if model.model is None else "trees")
    return judged.select("__row.*", "host", "path", found["rule"].alias("rule"), verdict.alias("verdict"), judge_of.alias("judged_by"))


def query(spark, sf_dir):
    """Every page's URL judged, by trees fitted on the pages' seed labels where no rule fits.

    Where no host of the fitting half holds a seed word there are no trees and
    `judged_by` says so; callers with labels of their own pass them to `fit`.
    """
    from lateline.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(seed_labels(pages))).drop("url")
