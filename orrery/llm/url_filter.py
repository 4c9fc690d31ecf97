"""URL filters: rules first, gradient-boosted trees on lexical features for all others.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
and the longest that fits wins.  URLs that a rule decides are the labelled
ones: the trees are trained in numpy from at most ``sample_rows`` different ones
of them (the lowest by hash), and every other URL takes their verdict.  Suffix
statistics are counts over all labelled rows, joined to every row.  Features
and trees are built-in column expressions, so that scoring stays in generated
code.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the trees; without labelled rows, or with
one label only, the trees answer with that label, or ``allow``; equal rows
give equal rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, checkpoint, let

ALLOW, BLOCK = "allow", "block"
# The rules of the contract.
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
SAMPLE_ROWS = 20_000
#: Rows of weight that a suffix's share of blocked URLs takes from the overall share.
PRIOR = 5
#: Suffixes whose shares are sent to all tasks; beyond that they are joined by shuffles.
SUFFIXES_SENT = 100_000
FEATURES = (
    "length", "depth", "digit_ratio", "entropy", "params", "host_length", "labels", "hyphens", "top_rate", "pair_rate",
)


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, _after(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def _after(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.substr(url, F.instr(url, "://") + F.lit(3))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, _after(url))
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""

    def over(n: Column) -> Column:
        share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
        chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
        return F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))

    return F.when(F.length(text) > 0, let(F.length(text).cast("double"), over)).otherwise(F.lit(0.0))


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features but the suffix statistics."""
    length = F.length(url).cast("double")
    digits = length - F.length(F.regexp_replace(url, "[0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return [
        length,
        F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        F.when(length > 0, digits / length).otherwise(F.lit(0.0)),
        entropy(url),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        F.length(host).cast("double"),
        F.size(F.split(host, r"\.")).cast("double"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
    ]


@dataclass
class Boosted:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values; log odds at the start."""

    start: float
    trees: list

    def margin(self, features: list[Column]) -> Column:
        def grow(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, threshold, left, right = tree
            return F.when(features[feature] <= threshold, grow(left)).otherwise(grow(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + grow(tree)
        return total


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 20) -> Boosted:
    """Newton boosting of the logistic loss with exact quantile splits."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(share / (1 - share))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]
    score = np.full(len(y), model.start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = -g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None)
        if left:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                b = bins[f][rows]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1] is None:
            score[rows] += rate * value
            return float(rate * value)
        f, k = best[1]
        low = bins[f][rows] <= k
        return (f, float(cuts[f][k]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        model.trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return model


def judged_by_rules(pages: DataFrame, id_col: str, url_col: str, rules=RULES) -> DataFrame:
    """id, _u, host, path, rule, _ruled, _top and _pair (the host's last one and two labels)."""
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_u"))
    rows = rows.withColumn("host", host_of(F.col("_u"))).withColumn("path", path_of(F.col("_u")))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_ruled", verdict)
    return rows.withColumn("_top", suffix(F.col("host"), 1)).withColumn("_pair", suffix(F.col("host"), 2))


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """_top, _top_rate and _pair, _pair_rate: smoothed shares of blocked URLs among all labelled rows; the share of all."""
    counts = labelled.groupBy("_pair", "_top").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_ruled") == BLOCK).alias("b"))
    counts = checkpoint(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    every = (total["b"] + 1) / (total["n"] + 2)

    def rates(key: str) -> DataFrame:
        each = counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        return each.select(key, ((F.col("b") + PRIOR * every) / (F.col("n") + PRIOR)).alias(f"{key}_rate"))

    return rates("_top"), rates("_pair"), every


def with_features(rows: DataFrame, tops: DataFrame, pairs: DataFrame, every: float, sent: bool) -> DataFrame:
    """Adds ``_x``, the features in order."""
    for key, rates in (("_top", tops), ("_pair", pairs)):
        rows = rows.join(F.broadcast(rates) if sent else rates, key, "left")
    plain = lexical(F.col("_u"), F.col("host"), F.col("path"))
    return rows.withColumn("_x", F.array(*plain, *(F.coalesce(F.col(f"{k}_rate"), F.lit(every)) for k in ("_top", "_pair"))))


def fit_urls(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Boosted, DataFrame]:
    """The trees, and all rows with their features."""
    labelled = rows.where(F.col("_ruled").isNotNull())
    tops, pairs, every = suffix_rates(labelled)
    sent = pairs.count() <= SUFFIXES_SENT
    # the same URL is one example, however often it stands there
    sample = labelled.select("_u", "host", "path", "_ruled", "_top", "_pair").distinct().orderBy(F.xxhash64("_u"), "_u").limit(sample_rows)
    got = with_features(sample, tops, pairs, every, sent).orderBy("_u").select("_x", (F.col("_ruled") == BLOCK).cast("double").alias("y")).toArrow()  # at most sample_rows
    x = np.array(got["_x"].to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return fit_boosted(x, got["y"].to_numpy()), with_features(rows, tops, pairs, every, sent)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, host, path, rule, verdict and ``block_score`` (the trees' probability)."""
    model, rows = fit_urls(judged_by_rules(pages, id_col, url_col, rules), sample_rows)
    margin = model.margin([F.get("_x", F.lit(i)) for i in range(len(FEATURES))]) if model.trees else F.lit(model.start)
    rows = rows.withColumn("_m", margin)
    return rows.select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("_ruled", F.when(F.col("_m") > 0, BLOCK).otherwise(ALLOW)).alias("verdict"),
        (1 / (1 + F.exp(-F.col("_m")))).alias("block_score"),
    )


def op5_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).withColumn("block_score", F.round("block_score", 9))
