r"""Personal data (operator 11, native): candidate gradient boosting.

Base kinds (email, ip, card, phone) are found by pattern in every whole text, leftmost and non-overlapping,
and tested: parts of an address up to 255, digit counts, Luhn's sum. They are always reported.

The method adds what patterns that strict miss. For each base kind a high-recall generator proposes loose
spans (mailbox, host, account, number: other separators, national numbers, spelt-out signs); proposals of
different kinds overlap freely. Boosted trees, one model a kind, score a proposal by format (digits, groups,
labels, Luhn, octets) and context (characters around it, cue words before it); the marks that define the
base kind itself (``@``, ``+`` with its country code, separators) are left out, so that a model carries over
to proposals without them. Proposals that meet a base span of their kind are the positive examples, all
others the negative ones: a form without those marks that is as common as the base form counts against
itself, and only rare ones, up to 1 - PRECISION of the positive ones alike to them, are added.
Trees are fitted on at most SAMPLE proposals a kind, those with the least hash, of two thirds of the texts.
Thresholds are calibrated on all proposals of the other third: the lowest score at or above which a share of
PRECISION are positive, with LEAST positives at least. A kind without such a score, or without examples of
both sorts, adds nothing. What is selected and meets no base span is reported; of a chain of overlapping
selected spans the one with the best score.

One scan of the texts writes what the generators found in the texts that hold a mark; only those rows, without
the rest of the text, are shuffled, by row. Trees and thresholds become one Spark expression. All statistics,
proposals and thresholds cover all rows; only the fit of the trees has a bound.

Defined results: a null text is empty; rows without matches have zero counts, the digest of the empty string
and empty spans; very long texts are scanned whole, every pattern runs in time linear in the text; rows that
repeat in doc_id and text share one scan and get one result each; a null doc_id is scanned like any other;
equal scores in a chain go to the earlier start, then the kind listed first; an empty table gives an empty
table. Other columns are not read, and ``redact`` carries them unread.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .urls import Tree, boost

#: Proposals a kind that trees are fitted on; held-out precision, and positives, that a threshold needs.
SAMPLE, PRECISION, LEAST, TREES = 8_000, 0.95, 20, 20
LEFT, RIGHT = 32, 8

# The base kinds' patterns. Loops that nothing can follow are possessive, and a start inside a
# run that failed from its beginning is not tried again: the matches are the same, the time is linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
OCTETS = rf"^{_PART}(?:\.{_PART}){{3}}$"

_AT, _DOT = r"(?:@|\x20?[(\[{](?i:at)[)\]}]\x20?)", r"(?:\.|\x20?[(\[{](?i:dot|\.)[)\]}]\x20?)"
MAILBOX = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{0,8}}+"
HOST = rf"(?<![0-9])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{2,7}}+(?![0-9])"
ACCOUNT = r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){10,22}+(?![0-9])"
NUMBER = r"(?<![0-9+])[+(]{0,2}+[0-9](?:[\x20().\/-]{0,3}[0-9]){6,14}+(?![0-9])"
#: Whatever a pattern finds needs one of these in the text.
MARK = r"@|[(\[{](?i:at)[)\]}]|\+[0-9]|[0-9][\x20()\[\]{}._/-]{0,3}[0-9]|[0-9]\x20?[(\[{](?i:dot|\.)[)\]}]"

BASE = ("email", "ip", "card", "phone")
LOOSE = ("mailbox", "host", "account", "number")
#: In the order kinds are listed.
PATTERNS = dict(zip(BASE + LOOSE, (EMAIL, IP, CARD, PHONE, MAILBOX, HOST, ACCOUNT, NUMBER)))
#: Words that often come before each base kind, and before numbers of other sorts.
CUES = {
    "email": "e-?mail|mailto|correo|courriel|contact|kontakt|write",
    "ip": "ip|host|server|address|adresse|gateway",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|iban|konto|account|cuenta",
    "phone": "tel|phone|call|fax|mobil|handy|appel|llam|cell|whatsapp",
}
OTHER = "order|invoice|isbn|issn|version|ref|token|date|serial|bestell|factura|commande"
FEATURES = (
    "digits", "groups", "longest", "last_group", "letters", "luhn", "octets", "labels", "ending",
    "before", "after", "cue", "other_cue", "digits_near",
)


def row_key(doc_id: Column, text: Column) -> Column:
    """The same for rows with the same doc_id and text; null for texts without any mark."""
    return F.when(text.rlike(MARK), F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def matches_of(text: Column) -> Column:
    """For every kind its matches in place: gap before, match, and the characters around it."""
    listed = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        # the one-element array holds both lists, so that neither is made again for an element
        both = F.array(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")))

        def parts(s: Column) -> Column:
            return F.transform(
                s["m"],
                lambda m, i: F.struct(F.length(F.get(s["g"], i)).alias("gap"), m.alias("m"), F.right(F.get(s["g"], i), F.lit(LEFT)).alias("l"), F.left(F.get(s["g"], i + 1), F.lit(RIGHT)).alias("r")),
            )

        listed.append(F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.get(F.transform(both, parts), F.lit(0)).alias("parts")))
    return F.filter(F.array(*listed), lambda k: F.size(k["parts"]) > 0)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's sum."""
    n = F.length(digits)
    ones = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: digits.substr(n - i + 1, F.lit(1)).cast("int"))
    twice = F.transform(ones, lambda x, i: F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.coalesce(F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def located(marked: DataFrame) -> DataFrame:
    """Rows (__p_key, __p_found) -> __p_key, kind, order, start, end, m, l, r; base matches that fail their test are dropped."""
    kinds = marked.select("__p_key", F.explode("__p_found").alias("k"))
    rows = kinds.select("__p_key", "k.kind", "k.order", F.posexplode("k.parts").alias("pos", "p"))
    so_far = Window.partitionBy("__p_key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("p.gap") + F.length("p.m")).cast("long")).over(so_far)
    rows = rows.select("__p_key", "kind", "order", (end - F.length("p.m")).alias("start"), end.alias("end"), "p.m", "p.l", "p.r")
    digits = F.regexp_replace("m", "[^0-9]+", "")
    n = F.length(digits)
    valid = (
        F.when(F.col("kind") == "ip", F.col("m").rlike(OCTETS))
        .when(F.col("kind") == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(True)
    )
    return rows.filter(valid)


def _meets(rows: DataFrame, base: Column, *keys: str) -> Column:
    """Whether a row overlaps a row of ``base`` with the same keys."""
    # growing frames both ways: a shrinking one would be computed anew for each row
    up, down = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    last = F.max(F.when(base, F.col("end"))).over(up)
    following = F.min(F.when(base, F.col("start"))).over(down)
    return F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))


def _class(char: Column) -> Column:
    """Sort of a neighbouring character: none, blank, letter, digit, quote, other."""
    return F.when(char == "", 0).when(char.rlike(r"^\s$"), 1).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike("^[0-9]$"), 3).when(char.rlike("^[\"'`]$"), 4).otherwise(5)


def features() -> dict[str, Column]:
    """Whole numbers for a proposal in columns m, l, r and family; a phone number's country code doesn't count."""
    m = F.regexp_replace("m", r"^\+[0-9]{1,3}(?![0-9])", "")
    digits = F.regexp_replace(m, "[^0-9]+", "")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    sizes = F.transform(groups, lambda x: F.length(x))
    host = F.split(F.regexp_replace(m, rf"^.*?{_AT}", ""), _DOT)

    def cue(words: str) -> Column:
        return F.lower("l").rlike(rf"\b(?:{words})").cast("int")

    near = F.concat("l", "r")
    own = reduce(lambda out, kind: F.when(F.col("family") == kind, cue(CUES[kind])).otherwise(out), BASE, F.lit(0))
    found = {
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.array_max(sizes),
        "last_group": F.get(sizes, F.size(sizes) - 1),
        "letters": F.length(m) - F.length(F.regexp_replace(m, "[A-Za-z]+", "")),
        "luhn": F.when(F.length(digits).between(11, 23), luhn(digits)).otherwise(False).cast("int"),
        "octets": (F.array_join(groups, ".").rlike(OCTETS)).cast("int"),
        "labels": F.size(host),
        "ending": F.get(host, F.size(host) - 1).rlike("^[A-Za-z]{2,6}$").cast("int"),
        "before": _class(F.right("l", F.lit(1))),
        "after": _class(F.left("r", F.lit(1))),
        "cue": own,
        "other_cue": cue(OTHER),
        "digits_near": F.length(near) - F.length(F.regexp_replace(near, "[0-9]+", "")),
    }
    return {f: F.coalesce(found[f], F.lit(0)).cast("int") for f in FEATURES}


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, __p_key (null without a mark) and __p_found of every row of ``docs``, written: the one scan of all texts."""
    text = text_or_empty()
    rows = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("__p_key"), text.alias("__p_text"))
    return materialize(rows.select("doc_id", "__p_key", F.when(F.col("__p_key").isNotNull(), matches_of(F.col("__p_text"))).alias("__p_found")), "pii-matches")


def proposals(rows: DataFrame) -> DataFrame:
    """Base spans and proposals of a scan, written: __p_key, kind, order, family, start, end, base, label, clear, held and features.

    ``label``: a proposal meets a base span of its family; ``clear``: it meets none of any; ``held``: its text is kept out of the fit.
    """
    marked = rows.filter(F.col("__p_key").isNotNull()).groupBy("__p_key").agg(F.first("__p_found").alias("__p_found"))
    base = F.col("kind").isin(*BASE)
    family = reduce(lambda out, pair: F.when(F.col("kind") == pair[0], pair[1]).otherwise(out), zip(LOOSE, BASE), F.col("kind"))
    found = located(marked).withColumn("family", family).withColumn("base", base)
    found = found.withColumn("clear", ~_meets(found, F.col("base"), "__p_key")).withColumn("label", _meets(found, F.col("base"), "__p_key", "family"))
    held = F.pmod(F.xxhash64("__p_key"), F.lit(3)) == 0
    return materialize(found.select("__p_key", "kind", "order", "family", "start", "end", "base", "label", "clear", held.alias("held"), F.struct(*[c.alias(f) for f, c in features().items()]).alias("f")), "pii-proposals")


class Model:
    """For each family a bias, trees and, once calibrated, a threshold in log odds; a family without one adds nothing."""

    def __init__(self, trees: dict[str, tuple[float, list[Tree]]]) -> None:
        self.trees, self.thresholds = trees, {}

    def log_odds(self) -> Column:
        """Of a row of :func:`proposals`; null for a family that has no trees."""
        named, out = [F.col("f")[f] for f in FEATURES], F.lit(None).cast("double")
        for family, (bias, trees) in self.trees.items():
            out = F.when(F.col("family") == family, reduce(lambda a, t: a + t.column(named), trees, F.lit(float(bias)))).otherwise(out)
        return out

    def selected(self) -> Column:
        return reduce(lambda a, x: a | ((F.col("family") == x[0]) & (F.col("odds") >= F.lit(float(x[1])))), self.thresholds.items(), F.lit(False))


def fit(found: DataFrame, sample: int = SAMPLE) -> Model:
    """Trees from at most ``sample`` proposals a family: those with the least hash outside the held-out texts."""
    known = found.filter(~F.col("base") & ~F.col("held"))
    chance = F.xxhash64(F.lit(11), F.col("__p_key"), F.col("start"), F.col("end"))
    parts = [known.filter(F.col("family") == x).orderBy(chance, "__p_key", "start", "end").limit(sample).select("family", "label", "f") for x in BASE]
    rows = sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda r: (r["family"], tuple(r["f"]), r["label"]))
    trees = {}
    for x in BASE:
        mine = [r for r in rows if r["family"] == x]
        y = np.array([r["label"] for r in mine], dtype=float)
        if len(set(y)) == 2:
            trees[x] = boost(np.array([tuple(r["f"]) for r in mine], dtype=float), y, TREES)
    return Model(trees)


def calibrate(model: Model, scored: DataFrame, precision: float = PRECISION, least: int = LEAST, steps: int = 20) -> Model:
    """Thresholds from all held-out proposals, counted by log odds in steps of 1 / ``steps`` from -10 to 10."""
    step = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("odds"))) * steps)
    held = scored.filter(~F.col("base") & F.col("held") & F.col("odds").isNotNull())
    counts = held.groupBy("family", step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("good")).collect()  # at most 4 * (20 * steps + 1) rows
    for x in BASE:
        n = good = 0
        for r in sorted((r for r in counts if r["family"] == x), key=lambda r: -r["step"]):
            n, good = n + r["n"], good + r["good"]
            if good >= least and good >= precision * n:
                model.thresholds[x] = r["step"] / steps if r["step"] > -10 * steps else float("-inf")
    return model


def chosen(scored: DataFrame, model: Model) -> DataFrame:
    """__p_key, kind, order, start, end of base spans and of the best selected proposal of each chain."""
    picked = scored.filter(~F.col("base") & F.col("clear") & model.selected())
    up = Window.partitionBy("__p_key").orderBy("start", "end", "order")
    before = F.max("end").over(up.rowsBetween(Window.unboundedPreceding, -1))
    rows = picked.withColumn("__new", F.coalesce((F.col("start") >= before).cast("long"), F.lit(1).cast("long")))
    rows = rows.withColumn("__chain", F.sum("__new").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = Window.partitionBy("__p_key", "__chain").orderBy(F.desc("odds"), "start", "order")
    rows = rows.withColumn("__r", F.row_number().over(best)).filter("__r = 1")
    columns = ["__p_key", "kind", "order", "start", "end"]
    return scored.filter("base").select(*columns).unionByName(rows.select(*columns))


def spans_by_key(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """__p_key, parts (sorted array of start, order, kind, end) of the marked rows of a scan; trees are fitted on it if none are given."""
    found = proposals(rows)
    fitted = fit(found) if model is None else model
    scored = found.withColumn("odds", fitted.log_odds()).select("__p_key", "kind", "order", "family", "start", "end", "base", "label", "clear", "held", "odds")
    if model is None:
        scored = materialize(scored, "pii-scores")
        calibrate(fitted, scored)
    parts = chosen(scored, fitted)
    return parts.groupBy("__p_key").agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("parts"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and parts (null where nothing is found) of every row of ``docs`` (doc_id, text)."""
    rows = scanned(docs)
    found = spans_by_key(rows, model)
    clean = rows.filter(F.col("__p_key").isNull()).select("doc_id", F.lit(None).cast(found.schema["parts"].dataType).alias("parts"))
    return clean.unionByName(rows.filter(F.col("__p_key").isNotNull()).select("doc_id", "__p_key").join(found, "__p_key", "left").select("doc_id", "parts"))


def listed(parts: Column) -> Column:
    one = F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string")))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def digests(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; n_added counts the method's own."""
    parts = F.col("parts")

    def count(kinds: tuple[str, ...]) -> Column:
        return F.greatest(F.coalesce(F.size(F.filter(parts, lambda p: p["kind"].isin(*kinds))), F.lit(0)), F.lit(0)).cast("long")

    counts = [count((k,)).alias(f"n_{k}") for k in BASE]
    base = listed(F.filter(parts, lambda p: p["kind"].isin(*BASE)))
    return scan(docs, model).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(parts).alias("spans"), count(LOOSE).alias("n_added"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, n_chars set anew; overlapping spans are masked as one.

    Only texts that hold a mark are shuffled, once, by row key.
    """
    columns, text = docs.columns, text_or_empty()
    found = spans_by_key(scanned(docs), model)
    rows = docs.withColumn("__p_key", row_key(F.col("doc_id"), text))
    clean = rows.filter(F.col("__p_key").isNull()).select(*columns)
    marked = rows.filter(F.col("__p_key").isNotNull()).select("__p_key", text.alias("__p_text"), F.struct(*columns).alias("__p_row"))
    hits = marked.join(found, "__p_key", "left")
    edge, row = F.lit(0).cast("long"), F.col("__p_row")
    start = F.struct(edge.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.col("__p_text").substr((acc["at"] + 1).cast("int"), (p["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), p["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.when(p["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.col("__p_text").substr((acc["at"] + 1).cast("int"), F.length("__p_text")))

    hits = hits.withColumn("__p_new", F.when(F.col("parts").isNull(), row["text"]).otherwise(F.aggregate("parts", start, step, finish)))
    new = {"text": F.col("__p_new")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("parts").isNull(), row["n_chars"]).otherwise(F.length("__p_new").cast("long"))
    return clean.unionByName(hits.select(*[new.get(c, row[c]).alias(c) for c in columns]))
