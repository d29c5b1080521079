r"""Secret scans (operator 4, native): multipart credential linking.

Base kinds are found by pattern in every whole text, leftmost and non-overlapping. Offsets come
from the gaps between matches: ``split`` by the pattern gives the gaps, ``regexp_extract_all`` the
matches, and prefix sums of both lengths give code point spans.

The method adds weak kinds: ``ident`` (named access identifiers), ``loose`` (random-looking bare
strings) and ``endpoint`` (service addresses). Alone they prove nothing. An interval join within
one text links parts whose starts lie at most SCOPE code points apart: a loose secret counts with
an identifier, an identifier with a secret, an endpoint with both. The join is by buckets of SCOPE
code points, of which only the first and last start per role are kept, so it makes at most three
rows per part whatever a bucket holds.

One scan marks texts by a cheap pattern and finds the parts of the marked ones; what it writes, and
all that is shuffled, are row keys and lengths. A redaction shuffles marked texts once, by row key.

Defined results: a null text is empty; rows without matches have zero counts, the digest of the
empty string and empty spans; weak parts that overlap a base span are dropped, base spans stay;
rows that repeat in doc_id and text share one scan and get one result each; a null doc_id is
scanned like any other; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_of, hit, materialize, text_or_empty

SCOPE = 200

# The base kinds' patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a shorter match holds no longer one
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more: runs are maximal

IDENT = r"""(?i:(client_?id|access_?key(?:_?id)?|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp)://[^\x20\x09-\x0D"'<>]+"""
LOOSE = r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
#: Whatever is reported needs one of these in the text.
MARK = r"(?i:password|passwd|secret|token|api_?key|client_?id|access_?key|account_?id|user_?name|login)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

#: kind -> (pattern, group whose length counts, least length); in the order kinds are listed.
KINDS = {
    "assign": (ASSIGN, 2, 8),
    "access": (ACCESS, 0, 16),
    "hex": (HEX, 0, 32),
    "ident": (IDENT, 0, 0),
    "loose": (LOOSE, 0, 20),
    "endpoint": (ENDPOINT, 0, 0),
}
BASE = ("assign", "access", "hex")


def row_key(doc_id: Column, text: Column) -> Column:
    """The same for rows with the same doc_id and text; null for texts without any mark."""
    return F.when(text.rlike(MARK), F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def kinds_of(text: Column) -> Column:
    """For every kind the lengths of gaps, matches and counted groups in ``text``, in place."""
    listed = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
        counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        zipped = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("len"), counted.alias("counted")), lambda p: p["len"].isNotNull())
        listed.append(F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.lit(least).alias("least"), zipped.alias("parts")))
    return F.filter(F.array(*listed), lambda k: F.size(k["parts"]) > 0)


def found_parts(marked: DataFrame) -> DataFrame:
    """__s_key, kind, order, start, end of every part in rows (__s_key, __s_kinds)."""
    kinds = marked.select("__s_key", F.explode("__s_kinds").alias("k"))
    rows = kinds.select("__s_key", "k.kind", "k.order", "k.least", F.posexplode("k.parts").alias("pos", "p"))
    before = Window.partitionBy("__s_key", "kind").orderBy("pos")
    so_far = F.sum(F.col("p.gap") + F.col("p.len")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = rows.withColumn("end", so_far).withColumn("start", so_far - F.col("p.len"))
    return spans.filter(F.col("p.counted") >= F.col("least")).select("__s_key", "kind", "order", "start", "end")


def without_covered(parts: DataFrame) -> DataFrame:
    """Drops weak parts that overlap a base span of the same text."""
    base = F.col("kind").isin(*BASE)
    up = Window.partitionBy("__s_key").orderBy("start", "order")
    last_end = F.max(F.when(base, F.col("end"))).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = Window.partitionBy("__s_key").orderBy("start", "order").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    next_start = F.min(F.when(base, F.col("start"))).over(after)
    rows = parts.withColumn("__le", last_end).withColumn("__ns", next_start)
    clear = F.coalesce(F.col("__le") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__ns") >= F.col("end"), F.lit(True))
    return rows.filter(base | clear).drop("__le", "__ns")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base parts, and the weak ones that complementary parts lie near."""
    ident, secret = F.col("kind").isin("access", "ident"), F.col("kind").isin("assign", "hex", "loose")
    rows = parts.withColumn("__bucket", F.floor(F.col("start") / scope))
    ends = rows.groupBy("__s_key", F.col("__bucket").alias("__near")).agg(
        F.min(F.when(ident, F.col("start"))).alias("__i0"),
        F.max(F.when(ident, F.col("start"))).alias("__i1"),
        F.min(F.when(secret, F.col("start"))).alias("__c0"),
        F.max(F.when(secret, F.col("start"))).alias("__c1"),
    )
    weak = rows.filter(~F.col("kind").isin(*BASE))
    asked = weak.withColumn("__near", F.explode(F.array(F.col("__bucket") - 1, F.col("__bucket"), F.col("__bucket") + 1)))

    def near(*names: str) -> Column:
        tests = [F.coalesce(F.abs(F.col(n) - F.col("start")) <= scope, F.lit(False)) for n in names]
        return F.max(reduce(lambda a, b: a | b, tests))

    keys = ["__s_key", "kind", "order", "start", "end"]
    met = asked.join(ends, ["__s_key", "__near"]).groupBy(*keys).agg(near("__i0", "__i1").alias("__i"), near("__c0", "__c1").alias("__c"))
    wanted = (
        F.when(F.col("kind") == "loose", F.col("__i")).when(F.col("kind") == "ident", F.col("__c")).otherwise(F.col("__i") & F.col("__c"))
    )
    return parts.filter(F.col("kind").isin(*BASE)).unionByName(met.filter(wanted).select(*keys))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, __s_key (null without a mark) and __s_kinds of every row of ``docs``, written: the one scan of all texts."""
    text = text_or_empty()
    rows = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("__s_key"), text.alias("__s_text"))
    return materialize(rows.select("doc_id", "__s_key", F.when(F.col("__s_key").isNotNull(), kinds_of(F.col("__s_text"))).alias("__s_kinds")), "secret-parts")


def spans_by_key(rows: DataFrame) -> DataFrame:
    """__s_key, parts (sorted array of start, order, kind, end) of the marked rows of a scan."""
    marked = rows.filter(F.col("__s_key").isNotNull()).groupBy("__s_key").agg(F.first("__s_kinds").alias("__s_kinds"))
    parts = linked(without_covered(found_parts(marked)))
    return parts.groupBy("__s_key").agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("parts"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and parts (null where nothing is found) of every row of ``docs`` (doc_id, text)."""
    rows = scanned(docs)
    found = spans_by_key(rows)
    clean = rows.filter(F.col("__s_key").isNull()).select("doc_id", F.lit(None).cast(found.schema["parts"].dataType).alias("parts"))
    marked = rows.filter(F.col("__s_key").isNotNull()).select("doc_id", "__s_key").join(found, "__s_key", "left").select("doc_id", "parts")
    return clean.unionByName(marked)


def listed(parts: Column) -> Column:
    one = F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string")))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; n_linked counts the method's own."""
    parts = F.col("parts")
    base = F.filter(parts, lambda p: p["kind"].isin(*BASE))

    def count(kinds: list[str]) -> Column:
        return F.greatest(F.coalesce(F.size(F.filter(parts, lambda p: p["kind"].isin(*kinds))), F.lit(0)), F.lit(0)).cast("long")

    counts = [count([k]).alias(f"n_{k}") for k in BASE]
    n_linked = count([k for k in KINDS if k not in BASE]).alias("n_linked")
    return scan(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(parts).alias("spans"), n_linked)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask`` and n_chars set anew.

    The scan's row filter sorts out the rows without spans, which pass by untouched; only the few
    others are joined with their spans. Overlapping spans are masked as one.
    """
    columns = docs.columns
    found = materialize(spans_by_key(scanned(docs)).withColumn("rid", F.xxhash64("__s_key")), "secret-spans")
    words, shift = filter_of(found, found.count())
    text = text_or_empty()
    # the same number as that of the key, without the pattern that marks texts
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.withColumn("__s_key", key).withColumn("__s_rid", F.xxhash64("__s_key")).withColumn("__f_word", F.shiftrightunsigned("__s_rid", shift))
    rows = rows.join(F.broadcast(words), "__f_word", "left").withColumn("__s_hit", hit(F.col("__s_rid")))
    clean = rows.filter(~F.col("__s_hit")).select(*columns)
    marked = rows.filter("__s_hit").select("__s_key", text.alias("__s_text"), F.struct(*columns).alias("__s_row"))
    hits = marked.join(found.select("__s_key", F.col("parts").alias("__s_parts")), "__s_key", "left")
    parts, row = F.col("__s_parts"), F.col("__s_row")
    edge = F.lit(0).cast("long")
    start = F.struct(edge.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin, end = p["start"].cast("long"), p["end"].cast("long")
        fresh = F.concat(acc["out"], F.array(F.substring(F.col("__s_text"), acc["at"].cast("int") + 1, (begin - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(begin >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.substring(F.col("__s_text"), acc["at"].cast("int") + 1, F.length("__s_text"))
        return F.concat(F.array_join(acc["out"], ""), rest)

    changed = F.when(parts.isNull(), row["text"]).otherwise(F.aggregate(parts, start, step, finish))
    hits = hits.withColumn("__s_new", changed)
    new = {"text": F.col("__s_new")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(parts.isNull(), row["n_chars"]).otherwise(F.length("__s_new").cast("long"))
    return clean.unionByName(hits.select(*[new.get(c, row[c]).alias(c) for c in columns]))
