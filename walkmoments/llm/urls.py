"""URL filters (operator 5): rules, and gradient-boosted trees on lexical features.

Rules of (verdict, host, path) come first: a rule fits its host and all subdomains if the url's
path starts with the rule's path, and the longest wins. What no rule decides is judged by boosted
trees on length, depth, digit ratio, entropy, parameter counts and suffix statistics, trained from
labelled URLs. The trees are fitted on the driver from at most SAMPLE labelled rows, those with
the least hash; suffix statistics are counted over all labelled rows, for every suffix seen, and
smoothed by the prior. Suffixes with at least 1 / SUFFIXES of the labelled rows, or of the rows to
judge, hence at most twice SUFFIXES of each kind, are broadcast; the rest are a table that is joined
by suffix, none of them hot. The fitted trees become one Spark expression, so scoring needs no Python.

The registered query has no labels but the rules' own verdicts: its trees carry the rules' decisions on
to urls that look like those they decide, and their held-out accuracy says how well they do that (the
feature of host label and folder comes near the rules themselves), not how well they know bad sites.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; the
trees judge it like any other; without labelled rows of both kinds the verdict is that of the
only kind seen, else allow; repeated rows are judged each; very long urls are read whole, in one
row; an empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

SAMPLE, SUFFIXES = 20_000, 500
FEATURES = ("length", "host_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "last_label", "last_labels", "label_and_folder")
BINS, TREES, DEPTH, RATE, LEAST = 32, 30, 3, 0.3, 8

# The rules of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds __u_host and __u_path, never null."""
    url = F.col(url_col).cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rows = pages.withColumn("__u_rest", F.coalesce(after, F.lit("")))
    rest, raw = F.col("__u_rest"), F.regexp_extract("__u_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return rows.withColumn("__u_host", F.translate(raw, upper, upper.lower())).withColumn("__u_path", path).drop("__u_rest")


def decide(rules: tuple) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; null if none does."""
    host, path = F.col("__u_host"), F.col("__u_path")
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffixes() -> dict[str, Column]:
    host, folder = F.col("__u_host"), F.get(F.split("__u_path", "/", 3), F.lit(1))
    return {
        "last_label": F.substring_index(host, ".", -1),
        "last_labels": F.substring_index(host, ".", -2),
        "label_and_folder": F.concat_ws("/", F.substring_index(host, ".", -1), F.coalesce(folder, F.lit(""))),
    }


def lexical(url: Column) -> dict[str, Column]:
    host, path = F.col("__u_host"), F.col("__u_path")
    text = F.coalesce(url.cast("string"), F.lit(""))
    n = F.length(text)
    chars = F.split(F.lower(text), "")
    share = F.transform(
        F.array_distinct(chars),
        lambda c: (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), c, F.lit("")))).cast("double") / F.greatest(n, F.lit(1)),
    )
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_ratio": (n - F.length(F.regexp_replace(text, "[0-9]+", ""))).cast("double") / F.greatest(n, F.lit(1)),
        "entropy": entropy,
        "parameters": (F.size(F.split(text, "[?&]")) - 1).cast("double"),
        "hyphens": (n - F.length(F.replace(text, F.lit("-"), F.lit("")))).cast("double"),
    }


@dataclass
class Tree:
    feature: int = -1
    threshold: float = 0.0
    value: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, named: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(named[self.feature] <= F.lit(self.threshold), self.low.column(named)).otherwise(self.high.column(named))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.low.predict(x), self.high.predict(x))


@dataclass
class UrlModel:
    """Boosted trees for the log odds of block, and the suffix statistics they read."""

    bias: float
    trees: list[Tree] = field(default_factory=list)
    rates: list[tuple[str, str, float]] = field(default_factory=list)  # feature, suffix, rate of block
    prior: float = 0.5
    rare: DataFrame | None = None  # kind, suffix, rate of the suffixes that are not in ``rates``

    def hot_rates(self, rows: DataFrame) -> dict[str, dict[str, float | None]]:
        """By kind, the rate (None if it has none) of every suffix that 1 / SUFFIXES of ``rows`` have: at most SUFFIXES of a kind.

        Suffixes are counted map-side first, so a hot one is a row a task here, and none is joined by key later.
        """
        kinds = suffixes()
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("suffix")) for k, v in kinds.items()]))
        counts = materialize(rows.select(pairs.alias("s")).groupBy("s.kind", "s.suffix").agg(F.count("*").alias("n")), "url-seen")
        total = counts.filter(F.col("kind") == next(iter(kinds))).agg(F.sum("n")).first()[0] or 0
        hot = counts.filter(F.col("n") * SUFFIXES >= total).select("kind", "suffix")
        out: dict[str, dict[str, float | None]] = {k: {} for k in kinds}
        for r in hot.join(self.rare, ["kind", "suffix"], "left").collect():
            out[r["kind"]][r["suffix"]] = r["rate"]
        drop_table(counts)
        return out

    def with_features(self, rows: DataFrame, url: Column) -> DataFrame:
        """Adds __u_features.

        Suffixes that are common among the labelled rows or among ``rows``, at most SUFFIXES each for
        a kind, are broadcast; a suffix that is joined by key has less than 1 / SUFFIXES of ``rows``.
        """
        spark, out = rows.sparkSession, rows
        hot = {} if self.rare is None else self.hot_rates(rows)
        for kind, value in suffixes().items():
            known = hot.get(kind, {}) | {s: r for f, s, r in self.rates if f == kind}
            keyed, key, rate = out.withColumn(f"__u_s_{kind}", value), f"__u_s_{kind}", f"__u_r_{kind}"
            if known:
                pairs = [F.struct(F.lit(s).alias(key), F.lit(r).cast("double").alias(rate), F.lit(True).alias("__u_c")) for s, r in sorted(known.items())]
                small = spark.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
                out = keyed.join(F.broadcast(small), key, "left")
            else:
                out = keyed.withColumn(rate, F.lit(None).cast("double")).withColumn("__u_c", F.lit(None).cast("boolean"))
            if self.rare is not None:
                # rows of broadcast suffixes are dealt by a hash of the url, so none of these meets in a task
                away = F.when(F.col("__u_c"), F.xxhash64(url)).otherwise(F.lit(0))
                more = self.rare.filter(F.col("kind") == kind).select(F.col("suffix").alias("__u_k"), F.lit(0).cast("long").alias("__u_a"), F.col("rate").alias("__u_m"))
                out = out.withColumn("__u_a", away.cast("long")).withColumn("__u_k", F.when(F.col("__u_c"), F.lit("")).otherwise(F.col(key)))
                out = out.join(more, ["__u_k", "__u_a"], "left").withColumn(rate, F.coalesce(rate, "__u_m")).drop("__u_k", "__u_a", "__u_m")
            out = out.drop("__u_c")
        columns = lexical(url) | {k: F.coalesce(F.col(f"__u_r_{k}"), F.lit(float(self.prior))) for k in suffixes()}
        out = out.withColumn("__u_features", F.struct(*[columns[f].alias(f) for f in FEATURES]))
        return out.drop(*[f"__u_{x}_{k}" for x in "sr" for k in suffixes()])

    def log_odds(self) -> Column:
        named = [F.col("__u_features")[f] for f in FEATURES]
        out = F.lit(float(self.bias))
        for tree in self.trees:
            out = out + tree.column(named)
        return out


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = Tree(value=RATE * g / (h + 1.0))
    if depth == 0 or len(rows) < 2 * LEAST:
        return leaf
    best, best_gain = None, 1e-6
    for f in range(x.shape[1]):
        bins = binned[rows, f]
        size = len(edges[f]) + 1
        gs = np.cumsum(np.bincount(bins, grad[rows], size))[:-1]
        hs = np.cumsum(np.bincount(bins, hess[rows], size))[:-1]
        ns = np.cumsum(np.bincount(bins, minlength=size))[:-1]
        ok = (ns >= LEAST) & (len(rows) - ns >= LEAST)
        if not ok.any():
            continue
        gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
        k = int(np.argmax(gain))
        if gain[k] > best_gain:
            best, best_gain = (f, k), gain[k]
    if best is None:
        return leaf
    f, k = best
    low = binned[rows, f] <= k
    return Tree(f, float(edges[f][k]), 0.0, grow(x, binned, edges, grad, hess, rows[low], depth - 1), grow(x, binned, edges, grad, hess, rows[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    """Logistic boosting with histogram splits; x (rows, features), y 0 or 1."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias, out = math.log(rate / (1 - rate)), []
    if len(y) < 2 * LEAST or y.min() == y.max():
        return bias, out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    score = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, binned, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        out.append(tree)
        score += tree.predict(x)
    return bias, out


def fit(labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> UrlModel:
    """Fit from rows (id, url, __u_host, __u_path, __u_label with 1 for block)."""
    known = labelled.filter(F.col("__u_label").isNotNull())
    kinds = suffixes()
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("suffix")) for k, v in kinds.items()]))
    counts = known.select("__u_label", pairs.alias("s")).groupBy("s.kind", "s.suffix").agg(F.count("*").alias("n"), F.sum("__u_label").alias("bad"))
    total = known.agg(F.count("*").alias("n"), F.sum("__u_label").alias("bad")).first()
    prior = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    rate = (F.col("bad") + 4 * prior) / (F.col("n") + 4)
    counts = materialize(counts.withColumn("rate", rate).withColumn("common", F.col("n") * SUFFIXES >= total["n"]), "url-suffixes")
    rates = [(r["kind"], r["suffix"], r["rate"]) for r in counts.filter("common").collect()]  # at most SUFFIXES of each kind
    rare = counts.filter(~F.col("common")).select("kind", "suffix", "rate")
    model = UrlModel(0.0, [], rates, prior, None if rare.isEmpty() else rare)
    url = F.col(url_col)
    chosen = known.orderBy(F.xxhash64(F.lit(5), F.col(id_col), url), id_col, url_col).limit(sample)
    found = model.with_features(chosen.select(url_col, "__u_host", "__u_path", "__u_label"), url).select("__u_features", "__u_label").collect()
    found.sort(key=lambda r: (tuple(r[0]), r[1]))
    x = np.array([tuple(r[0]) for r in found], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in found], dtype=float)
    model.bias, model.trees = boost(x, y)
    return model


def judge(pages: DataFrame, rules: tuple = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds of every row of ``pages`` (page_id, url).

    Without a model the trees are trained on the rows that the rules decide.
    """
    name, verdict = decide(rules)
    rows = split_url(pages.select("page_id", "url")).withColumn("__u_rule", name).withColumn("__u_verdict", verdict)
    if model is None:
        model = fit(rows.withColumn("__u_label", (F.col("__u_verdict") == "block").cast("int")))
    odds = F.col("log_odds")
    return (
        model.with_features(rows, F.col("url"))
        .withColumn("log_odds", model.log_odds())
        .select(
            "page_id",
            F.col("__u_host").alias("host"),
            F.col("__u_path").alias("path"),
            F.col("__u_rule").alias("rule"),
            F.coalesce(F.col("__u_verdict"), F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
            "log_odds",
        )
    )
