"""Quality rules (operator 9, native): statistics, base rules and a learned decision list.

Statistics are Spark expressions over the whole text. The list is learned by sequential covering:
every labelled row falls into a cell of binned features; the cell counts, at most
``2 * 3 * BINS ** len(FEATURES)`` rows whatever the input's size, come to the driver, where
conjunctions of thresholds grow by information gain on two thirds of the rows and are pruned on
the rest. The result is an ordered Spark CASE expression. All labelled rows count; none is sampled.

Defined results: a null or empty text has no words and fails the base rules; a document without
words has all ratios 0; repeated rows are judged each; labels that are null, or whose doc_id is
null, teach nothing; a doc_id with several labels counts once per label row; without labels, or
without rows of both kinds, the list is empty and everything that passes the base rules is kept.
Other columns are carried unread, clashing names included (working columns start with ``__q_``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, drop_table, filter_of, hit, materialize, text_or_empty

#: Characters that part words, and those that count as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_upper")
FEATURES = ("mean_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "exclaim_ratio", "upper_ratio")
QUANTILES = (0.02, 0.25, 0.5, 0.75, 0.85, 0.92, 0.97)
BINS = len(QUANTILES) + 1
#: Sizes of the list, parameters of the method: rules, and conditions in one.
MOST_RULES, MOST_CONDITIONS = 24, 5
#: Index bits in a packed (hash, position) number; longer word lists take the unpacked way.
INDEX_BITS = 20


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__q_stats`` holding :data:`STATS` of every whole text."""
    bits, mask = INDEX_BITS, (1 << INDEX_BITS) - 1
    text = text_or_empty(text_col)
    trimmed = F.btrim(F.col("__q_text"), F.lit(BLANKS))
    words, grams, order, at = F.col("__q_words"), F.col("__q_grams"), F.col("__q_order"), F.col("__q_at")
    step = docs.withColumn("__q_text", text)
    step = step.withColumn("__q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)))
    triples = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    none = F.array().cast("array<bigint>")
    step = step.withColumn("__q_grams", F.when(F.size(words) >= 3, triples).otherwise(none))
    # (hash, position) packed in one number sorts as a primitive array
    packed = F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    step = step.withColumn("__q_order", F.when(F.size(grams) <= mask, packed).otherwise(none))

    def twin(x: Column, k: Column) -> Column:
        other = F.get(order, k)
        same = F.shiftright(other, bits) == F.shiftright(x, bits)
        full = F.get(grams, other.bitwiseAND(F.lit(mask)).cast("int")) == F.get(grams, x.bitwiseAND(F.lit(mask)).cast("int"))
        return F.coalesce(same & full, F.lit(False))

    found = F.transform(F.filter(order, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x.bitwiseAND(F.lit(mask)))

    def unpacked() -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        kept = F.transform(
            F.array(pairs),
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )
        return F.get(kept, F.lit(0))

    step = step.withColumn("__q_at", F.sort_array(F.when(F.size(grams) <= mask, found).otherwise(unpacked())))
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(3).cast("long"), F.get(at, k + 1) - x), F.lit(3).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    lines = F.filter(F.split(F.col("__q_text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.length(F.col("__q_text"))
    stats = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (n - F.length(F.regexp_replace("__q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (n - F.length(F.replace(F.col("__q_text"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        (n - F.length(F.regexp_replace("__q_text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    # the one-row explode keeps the optimizer from copying the statistics into every condition on them
    return step.withColumn("__q_stats", F.explode(F.array(stats))).drop("__q_text", "__q_words", "__q_grams", "__q_order", "__q_at")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(stats[a].cast("double"), stats[b].cast("double")), F.lit(0.0))

    return {
        "mean_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "exclaim_ratio": ratio("n_exclaim", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, named: dict[str, Column]) -> Column:
        value = named[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, and what none rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self, stats: Column) -> Column:
        """Number of the rule that rejects, from 1; null where the document is kept."""
        named, chain = features(stats), None
        for k, conditions in enumerate(self.rules, 1):
            test = F.lit(True)
            for c in conditions:
                test = test & c.column(named)
            chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
        return F.lit(None).cast("int") if chain is None else chain

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules]


def cell_counts(labelled: DataFrame) -> tuple[dict[str, list[float]], list]:
    """Thresholds per feature, and counts per (cell, fold, label) of rows (__q_stats, doc_id, quality).

    Cells are cut at quantiles; a threshold lies halfway between its quantile and the next greater
    value, which parts the labelled rows alike and leaves the widest margin for others.
    """
    named = features(F.col("__q_stats"))
    rows = labelled.select(*[named[f].alias(f) for f in FEATURES], F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"), F.col("quality").cast("int").alias("quality"))
    found = rows.agg(*[F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(found[f] or [])) for f in FEATURES}

    def cell(f: str) -> Column:
        out = F.lit(0)
        for e in edges[f]:
            out = out + (F.col(f) > F.lit(e)).cast("int")
        return out.alias(f)

    above = [F.min(F.when(F.col(f) > F.lit(e), F.col(f))).alias(f"{f}_{k}") for f in FEATURES for k, e in enumerate(edges[f])]
    next_value = rows.agg(*above, F.count("*").alias("n")).first()
    halfway = {f: [e if next_value[f"{f}_{k}"] is None else (e + next_value[f"{f}_{k}"]) / 2 for k, e in enumerate(edges[f])] for f in FEATURES}
    counts = rows.select(*[cell(f) for f in FEATURES], "fold", "quality").groupBy(*FEATURES, "fold", "quality").count()
    return halfway, counts.collect()  # at most 2 * 3 * BINS ** len(FEATURES) rows


def learn(edges: dict[str, list[float]], cells: list, precision: float = 0.9, support: float = 0.002, most_rules: int = MOST_RULES) -> DecisionList:
    """Sequential covering over counted cells: grow on folds 1 and 2, prune on fold 0.

    A rule has at most MOST_CONDITIONS conditions, the list at most ``most_rules`` rules. A rule that
    misses the precision or the support is not taken: the bad rows it was grown for are set aside, so
    that the next rule grows for others, until fewer are left than a rule must cover.
    """
    rows = [({f: r[f] for f in FEATURES}, r["fold"], r["quality"], r["count"]) for r in cells]
    total = sum(r[3] for r in rows)

    def holds(cell: dict[str, int], rule: list) -> bool:
        return all((cell[f] > k) == above for f, above, k in rule)

    def tally(part: list, rule: list) -> tuple[int, int]:
        bad = good = 0
        for cell, _, quality, n in part:
            if holds(cell, rule):
                bad, good = (bad + n, good) if quality == 0 else (bad, good + n)
        return bad, good

    rules: list[tuple[Condition, ...]] = []
    least, aside = max(3, support * total), set()  # aside: places in rows
    while len(rules) < most_rules:
        grow = [r for k, r in enumerate(rows) if r[1] and k not in aside]
        prune = [r for r in rows if not r[1]]
        if sum(r[3] for k, r in enumerate(rows) if r[2] == 0 and k not in aside) < least:
            break
        rule: list = []
        part = grow
        bad, good = tally(part, [])
        while good and bad:
            best, best_gain = None, 0.0
            before = math.log2(bad / (bad + good))
            bars = {f: [[0, 0] for _ in range(len(edges[f]) + 1)] for f in FEATURES}  # (bad, good) by bin
            for cell, _, quality, n in part:
                for f in FEATURES:
                    bars[f][cell[f]][quality] += n
            for f in FEATURES:
                low_bad = low_good = 0
                for k in range(len(edges[f])):
                    low_bad, low_good = low_bad + bars[f][k][0], low_good + bars[f][k][1]
                    for above, b, g in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                        if b and (gain := b * (math.log2(b / (b + g)) - before)) > best_gain + 1e-9:
                            best, best_gain = (f, above, k), gain
            if best is None or len(rule) >= MOST_CONDITIONS:
                break
            rule.append(best)
            part = [r for r in part if holds(r[0], [best])]
            bad, good = tally(part, [])

        def worth(r: list) -> float:
            b, g = tally(prune, r)
            return (b - g) / (b + g) if b + g else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        b, g = tally(rows, rule)
        pb, pg = tally(prune, rule)
        if b < least or b < precision * (b + g) or pb < precision * (pb + pg) or not rule:
            seed = {k for k, r in enumerate(rows) if k not in aside and r[2] == 0 and holds(r[0], rule)}
            if not seed:
                break
            aside |= seed
            continue
        rules.append(tuple(Condition(f, above, edges[f][k]) for f, above, k in rule))
        left = [k for k, r in enumerate(rows) if not holds(r[0], rule)]
        rows, aside = [rows[k] for k in left], {n for n, k in enumerate(left) if k in aside}
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """Learn from rows (doc_id, __q_stats) and labels (doc_id, quality 0 or 1).

    Rows that the base rules reject teach nothing: the list judges what those rules pass.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__q_id"), "quality")
    passed = stats.filter(~base_failed(F.col("__q_stats"))).select("doc_id", "__q_stats")
    joined = passed.join(known, passed["doc_id"] == known["__q_id"]).select("doc_id", "__q_stats", "quality")
    return learn(*cell_counts(joined))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (null if none) and kept to rows with ``__q_stats``."""
    s = F.col("__q_stats")
    out = stats.withColumn("base_failed", base_failed(s)).withColumn("rule", rules.verdict(s))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, rules: DecisionList | None = None) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the list, columns unchanged.

    Without ``rules`` they are learned from the labels of these documents, whose statistics are
    computed first: a filter of the labelled numbers chooses them. The verdict is computed in place,
    in the scan that passes the texts on: no text is shuffled.
    """
    if rules is None:
        known = labels.filter(F.col("doc_id").isNotNull()).select(F.xxhash64(F.col("doc_id").cast("long")).alias("rid"))
        words, shift = filter_of(known, known.count())
        rows = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("__q_rid")).withColumn("__f_word", F.shiftrightunsigned("__q_rid", shift))
        rows = rows.join(F.broadcast(words), "__f_word").filter(hit(F.col("__q_rid")))
        stats = materialize(with_stats(rows.select("doc_id", "text")).select("doc_id", "__q_stats"), "quality-stats")
        rules = fit(stats, labels)
        drop_table(stats)
    columns = docs.columns
    s = F.col("__q_stats")
    return with_stats(docs).filter(~base_failed(s) & rules.verdict(s).isNull()).select(*columns)
