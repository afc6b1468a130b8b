"""Url filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled urls.  Statistics of a url's suffix are taken
from the suffix's domains in other folds than the url's own, and only where
those are several: a label that a rule gave to a host must not come back as a
feature of the host's other urls.  For the same reason no feature is of the
host alone.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import sent_if_small, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bound of the training sample: about so many labelled urls, drawn by a hash of the url.
TRAIN_ROWS = 50_000
TREES, DEPTH = 20, 4
#: A suffix's shares count as so many urls of the overall mean besides its own.
PRIOR_ROWS = 20.0
#: Domains are dealt to so many folds; a suffix needs so many domains in the other folds to have statistics.
FOLDS, LEAST_DOMAINS = 10, 10
LEXICAL = ["length", "path_length", "depth", "hyphens", "digit_ratio", "letter_ratio", "entropy", "parameters", "escapes", "has_fragment", "is_https"]
#: Of the suffix's domains in other folds: urls and hosts (logarithms), means, and the share of blocked ones among labelled urls.
MEANS = ["depth", "digit_ratio", "entropy"]
SUFFIX = ["suffix_urls", "suffix_hosts", *[f"suffix_{name}" for name in MEANS], "suffix_blocked"]

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits; null if none does.

    A rule ``(verdict, host, path)`` fits its host and the hosts below it if
    the url's path starts with the rule's.
    """
    text: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for judged, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text = F.when(fits, name + start).otherwise(text)
        verdict = F.when(fits, judged).otherwise(verdict)
    return text, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.char_length(text).cast("double")

    def added(total: Column, sign: Column) -> Column:
        share = (size - F.char_length(F.replace(text, sign, F.lit("")))) / size
        return total - share * F.log2(share)

    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(size > 0, F.aggregate(signs, F.lit(0.0), added)).otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the lexical features and the suffixes the statistics are kept for."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": F.char_length(url).cast("double"),
            "path_length": F.char_length(path).cast("double"),
            "depth": _count(path, "/[^/]"),
            "hyphens": _count(url, "-"),
            "digit_ratio": _count(url, "[0-9]") / size,
            "letter_ratio": _count(url, "[A-Za-z]") / size,
            "entropy": _entropy(url),
            "parameters": _count(query, "[^&;]+"),
            "escapes": _count(url, "%[0-9A-Fa-f]{2}"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "is_https": F.startswith(F.lower(url), F.lit("https://")).cast("double"),
            "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
            "domain": F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1),
        }
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("domain", F.lit(3)), F.lit(FOLDS)).cast("int")


def suffix_table(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """``of_suffix, of_fold`` and sums over the suffix's domains in other folds, where these are ``LEAST_DOMAINS`` at least.

    Both inputs have url, host and path, the second one a label.  Urls are counted by host first.
    """
    sums = [F.sum(name).alias(name) for name in MEANS]
    hosts = with_features(urls.select("url", "host", "path")).groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("urls"), *sums)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("urls").alias("urls"), F.count(F.lit(1)).alias("hosts"), *sums)
    labels = with_features(labelled.select("url", "host", "path", "label")).groupBy("suffix", "domain").agg(F.count(F.lit(1)).alias("known"), F.sum("label").alias("blocked"))
    domains = domains.join(labels, ["suffix", "domain"], "full_outer").fillna(0)
    names = ["urls", "hosts", *MEANS, "known", "blocked", "domains"]
    folds = staged(domains.withColumn("domains", F.lit(1)).groupBy("suffix", _fold().alias("fold")).agg(*[F.sum(c).alias(c) for c in names]))
    whole = folds.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    others = folds.join(whole, "suffix").select(
        F.col("suffix").alias("of_suffix"), F.col("fold").alias("of_fold"), *[(F.col(f"all_{c}") - F.col(c)).alias(f"other_{c}") for c in names]
    )
    return staged(others.where(F.col("other_domains") >= LEAST_DOMAINS))


def _with_suffix(rows: DataFrame, table: DataFrame, means: dict[str, float]) -> DataFrame:
    """``rows`` (with features) and the statistics of their suffixes, drawn to the overall means; these alone where there are none."""
    joined = rows.join(sent_if_small(table), (F.col("suffix") == F.col("of_suffix")) & (_fold() == F.col("of_fold")), "left")
    held = lambda name: F.coalesce(F.col(f"other_{name}"), F.lit(0)).cast("double")
    drawn = lambda total, n, mean: (held(total) + PRIOR_ROWS * means[mean]) / (held(n) + PRIOR_ROWS)
    features = {"suffix_urls": F.log1p(held("urls")), "suffix_hosts": F.log1p(held("hosts")), "suffix_blocked": drawn("blocked", "known", "label")}
    features |= {f"suffix_{name}": drawn(name, "urls", name) for name in MEANS}
    return joined.withColumns(features).drop(*table.columns)


def judged(urls: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> DataFrame:
    """``urls`` (url, host, path, ...) with ``blocked``: the trees' probability that it is to be blocked.

    ``labelled`` has url, host, path and ``label`` (1: block, 0: allow).  At
    most about ``train_rows`` of them train the trees.  Without labelled urls
    the probability is 0, with one label alone it is that label.  A null url
    has the features of an empty one.
    """
    features = LEXICAL + SUFFIX
    known = staged(with_features(labelled.select("url", "host", "path", F.col("label").cast("double").alias("label"))))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("label"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if not total["n"] or total["least"] == total["most"]:
        return urls.withColumn("blocked", F.lit(float(total["label"] or 0.0)))
    table = suffix_table(urls, known)
    over_all = with_features(urls.select("url", "host", "path")).agg(*[F.avg(name).alias(name) for name in MEANS]).first()
    means = {"label": total["label"], **{name: over_all[name] or 0.0 for name in MEANS}}
    rate = min(1.0, train_rows / total["n"])
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known if rate == 1.0 else known.where(draw < rate)
    vector = VectorAssembler(inputCols=features, outputCol="features")
    train = staged(_with_suffix(sample, table, means).select(*features, "label").repartition(4))  # a bounded sample
    if train.select(F.count_distinct("label")).first()[0] < 2:
        return urls.withColumn("blocked", F.lit(float(total["label"])))
    model: GBTClassificationModel = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(vector.transform(train))
    given = [c for c in urls.columns if c != "blocked"]
    renamed = urls.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"), "url", "host", "path")
    scored = model.transform(vector.transform(_with_suffix(with_features(renamed), table, means)))
    return scored.select("given.*", vector_to_array("probability")[1].alias("blocked"))


def filtered(pages: DataFrame, rules: list[Rule], url_column: str = "url", threshold: float = 0.5, **options) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``blocked``; columns of those names are replaced.

    The verdict is the longest rule's.  Where no rule fits, it is the trees',
    which learn from the urls that rules judge.
    """
    names = ("host", "path", "rule", "verdict", "blocked")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    url = F.col(url_column).cast("string")
    rows = pages.select(F.struct(*kept).alias("page"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("by_rule", verdict)
    labelled = rows.where("by_rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    out = judged(rows, labelled, **options)
    by_trees = F.when(F.col("blocked") >= threshold, "block").otherwise("allow")
    return out.select("page.*", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "blocked")
