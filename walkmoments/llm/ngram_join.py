"""N-gram Jaccard join (operator 7): signature trees over exact blocking groups.

Two documents link when ``den * intersection >= num * union`` of their word shingle sets.

1. One Arrow map makes each document's set and writes its number, size and segment keys. Linked
   sets share a segment key (see shingles.py), so groups of equal keys miss no link.
2. Groups of two and more sets are kept, each named by its leader, the least set number. Each set is
   held against the leader of most of its groups, by bitmaps and then by members; what links points
   to its leader, and the pointers, doubled until they rest on roots, are preliminary classes.
3. All groups with one leader are one unit. Units that still hold several classes become signature
   trees (see sigtree.py), cut into blocks of about BLOCK sets and BLOCK_MEMBERS members. Dual
   traversal prunes node pairs by the greatest possible overlap and by class, and leaves candidate
   pairs, which are verified on their whole sets. A pair of blocks that has more than its part of
   DENSE candidates a set of the unit first gives each set's best one only; it is traversed again
   with the classes that these make, and then gives all that are left.
4. The components of all links label all documents with equal sets.

Only keys, numbers and the sets of documents that share a group are shuffled. No pairs within a
class are made, no group lies in one task as a whole, and nothing is capped.

Sets hold 64-bit hashes, and sets are told apart by a 64-bit number; both err only where 64-bit
hashes collide.

Defined results: null and empty texts have the empty set, are linked with nothing and are their own
component; documents with equal sets are linked; repeated rows are repeated in the result; a null
doc_id is never the least of a component, and a component of null ids alone has a null id; an
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sigtree
from .common import arrow_batches, drop_table, filter_of, hit, materialize, text_or_empty
from .components import components, roots
from .shingles import identity, segment_keys, sets_of

#: Sets, and members of sets, in one block of a unit; a task compares two blocks at most.
BLOCK, BLOCK_MEMBERS = 1024, 1 << 22
#: Candidates a set of a unit beyond which its blocks are dense.
DENSE = 8
#: Set numbers that a task remembers to give the keys of copies once.
SEEN = 1 << 17
#: Sets of one key that a task holds.
RUN = 1 << 22
#: Characters that part words.
BLANKS = " \t\n\x0b\f\r"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def row_number_of(doc_id: Column, tid: Column) -> Column:
    return F.xxhash64(doc_id, tid)


def keyed_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, tid (number of the text), cid (number of the set, null if empty), n_shingles, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets whose keys this task has given: copies need not repeat them
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = sets_of([(t or "").encode() for t in batch.column(2).to_pylist()], n)
                ids = [identity(s) if len(s) else None for s in sets]
                fresh = []
                for s, i in zip(sets, ids):
                    fresh.append(s if i is not None and i not in seen else s[:0])
                    seen.add(i)
                if len(seen) > SEEN:
                    seen = set()
                keys, offsets = segment_keys(fresh, num, den)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(ids, pa.int64()),
                        pa.array(map(len, sets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _long(keys)),
                    ],
                    names=["doc_id", "tid", "cid", "n_shingles", "keys"],
                )

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tid long, cid long, n_shingles long, keys array<long>")


def groups_of(sets: DataFrame) -> DataFrame:
    """key, cid, leader of every key that two or more sets hold; the leader is the least cid.

    Of a key that more than RUN sets hold, the least of the first RUN: the others follow as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None  # of the run that is open at a batch's end; its leader once that is fixed
        held: list[np.ndarray] = []

        def given(k: np.ndarray, c: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_long(k), _long(c), _long(leader)], names=["key", "cid", "leader"])

        def closed() -> Iterator[pa.RecordBatch]:
            c = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            if lead is not None or len(c) > 1:
                yield given(np.full(len(c), key), c, np.full(len(c), c[0] if lead is None else lead))

        for batch in batches:
            k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            order = np.lexsort((c, k))
            k, c = k[order], c[order]
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            k, c = k[fresh], c[fresh]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            first = 0
            if key is not None and k[0] == key:
                first = int(at[1]) if len(at) > 1 else len(k)
                held.append(c[:first])
            if first < len(k):  # the open run has ended
                if key is not None:
                    yield from closed()
                inner = at[at >= first]
                last = int(inner[-1])
                lengths = np.diff(inner)
                leader, many = np.repeat(c[inner[:-1]], lengths), np.repeat(lengths > 1, lengths)
                yield given(k[first:last][many], c[first:last][many], leader[many])
                key, lead, held = k[last], None, [c[last:]]
            if sum(map(len, held)) > RUN:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > RUN // 2:
                    lead = held[0][0] if lead is None else lead
                    yield from closed()
                    held = []
        if key is not None:
            yield from closed()

    rows = sets.filter(F.size("keys") > 0).select(F.explode("keys").alias("key"), "cid")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, cid long, leader long")


def units_of(sets: DataFrame, members: DataFrame) -> DataFrame:
    """cid, rid (number of one row with that set), leaders (of its groups), star (the leader of most of them, null if itself)."""
    near = groups_of(sets).repartition("cid").groupBy("cid", "leader").agg(F.count("*").alias("hits"))
    best = F.max(F.when(F.col("leader") < F.col("cid"), F.struct("hits", "leader"))).alias("best")
    of_set = near.groupBy("cid").agg(F.collect_list("leader").alias("leaders"), best)
    one = members.filter("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "tid")).alias("row"))
    rows = of_set.join(one, "cid")
    return rows.select("cid", row_number_of(F.col("row.doc_id"), F.col("row.tid")).alias("rid"), "leaders", F.col("best.leader").alias("star"))


def whole_sets(docs: DataFrame, units: DataFrame, n: int) -> DataFrame:
    """``units`` with size, members (array of hashes) and bitmap, from one row's text each.

    Texts are read again and pass the row filter; only those that pass are shuffled, and the join
    by number drops the few that passed by chance.
    """
    words, shift = filter_of(units, units.count())
    text, tid = text_or_empty(), F.xxhash64(text_or_empty())
    rows = docs.select(row_number_of(F.col("doc_id").cast("long"), tid).alias("rid"), text.alias("text"))
    rows = rows.withColumn("__f_word", F.shiftrightunsigned("rid", shift)).join(F.broadcast(words), "__f_word").filter(hit(F.col("rid")))
    one = rows.groupBy("rid").agg(F.first("text").alias("text")).join(units, "rid").select("cid", "leaders", "star", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = sets_of([(t or "").encode() for t in batch.column(3).to_pylist()], n)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array(map(len, sets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _long(np.concatenate(sets))),
                        pa.array([sigtree.bitmap_of(x) for x in sets], pa.binary()),
                    ],
                    names=["cid", "leaders", "star", "size", "members", "bitmap"],
                )

    return one.mapInArrow(hashed, "cid long, leaders array<long>, star long, size long, members array<long>, bitmap binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose whole sets link: their members are compared in the JVM.

    A row filter of the pairs' ends keeps the other sets from being shuffled.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).select(F.xxhash64("cid").alias("rid"))
    words, shift = filter_of(ends, 2 * pairs.count())
    asked = sets.select("cid", "members", F.xxhash64("cid").alias("rid")).withColumn("__f_word", F.shiftrightunsigned("rid", shift))
    asked = asked.join(F.broadcast(words), "__f_word").filter(hit(F.col("rid")))
    left = asked.select(F.col("cid").alias("a"), F.col("members").alias("sa"))
    right = asked.select(F.col("cid").alias("b"), F.col("members").alias("sb"))
    common, total = F.size(F.array_intersect("sa", "sb")).cast("long"), F.size("sa").cast("long") + F.size("sb")
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(common * (num + den) >= total * num).select("a", "b")


def star_candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: every set and its star, where sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(k).to_numpy() for k in (2, 3)]
            bound = np.array([sigtree.overlap_bound(int(m), x, int(n), y) for m, x, n, y in zip(sizes[0], batch.column(4).to_pylist(), sizes[1], batch.column(5).to_pylist())], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((num + den) * bound >= num * (sizes[0] + sizes[1])))

    left = sets.filter("star is not null").select(F.col("cid").alias("a"), F.col("star").alias("b"), F.col("size").alias("na"), F.col("bitmap").alias("ba"))
    right = sets.select(F.col("cid").alias("b"), F.col("size").alias("nb"), F.col("bitmap").alias("bb"))
    near = left.join(right, "b").filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return near.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def labelled(rows: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the component of ``col``; a set without links is its own."""
    named = labels.select(F.col("cid").alias("__l"), F.col("comp").alias("__c"))
    return rows.join(named, F.col(col) == F.col("__l"), "left").withColumn(out, F.coalesce("__c", col)).drop("__l", "__c")


def best_of_each(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the best pair of every set."""
    ends, at = np.concatenate([left, right]), np.tile(np.arange(len(left)), 2)
    order = np.lexsort((-score[at], ends))
    ends, at = ends[order], at[order]
    return np.unique(at[np.concatenate([[True], ends[1:] != ends[:-1]])]) if len(at) else at


def tree_candidates(sets: DataFrame, labels: DataFrame | None, num: int, den: int, dense: int | None, only: DataFrame | None = None) -> DataFrame:
    """a, b, dense: pairs of sets that share a unit, lie in different classes and may link.

    Each pair is given by the least unit that has both. A dense pair of blocks gives its sets' best
    pairs only, and its unit (as a and b) with ``dense`` true; ``dense`` None: all pairs. ``only``:
    units (key) to traverse.
    """
    rows = sets.select("cid", "size", "leaders")
    rows = rows.withColumn("comp", F.col("cid")) if labels is None else labelled(rows, labels, "cid", "comp")
    rows = rows.select("cid", "size", "comp", F.explode("leaders").alias("key"))
    if only is not None:
        rows = rows.join(only, "key", "left_semi")
    sums = rows.groupBy("key").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"), F.sum("size").alias("held"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("who")
    )
    # units of the same sets are one unit
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("held") / BLOCK_MEMBERS)).cast("int")
    kept = sums.filter("c0 <> c1").groupBy("who", "n").agg(F.min(F.struct(F.col("key"), blocks.alias("blocks"))).alias("k")).select("k.key", "k.blocks")
    own = rows.join(kept, "key").groupBy("cid").agg(F.first("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("key", "blocks"))).alias("units"))  # no more than a set has segments
    leaves = sets.select("cid", "size", "bitmap").join(own, "cid").select("cid", "size", "bitmap", "comp", F.col("units.key").alias("keys"), F.explode("units").alias("unit"))
    place = F.pmod(F.xxhash64("cid"), F.col("unit.blocks")).cast("int")
    full = leaves.withColumn("own", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("unit.blocks") - 1))).select(
        F.col("unit.key").alias("key"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "cid",
        "comp",
        "size",
        "bitmap",
        "keys",
        F.col("unit.blocks").alias("blocks"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            k, i, j = (t.column(x).to_numpy() for x in ("key", "i", "j"))
            cols = {x: t.column(x).to_numpy() for x in ("side", "cid", "comp", "size", "blocks")}
            maps = t.column("bitmap").to_pylist()
            lists = t.column("keys").combine_chunks()
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            found: list[tuple] = []
            for a, z in zip(at, np.append(at[1:], len(k))):
                if z - a < 2:
                    continue
                here = np.arange(a, z)
                left, right, score = sigtree.candidates(cols["size"][a:z], maps[a:z], cols["comp"][a:z], here, cols["side"][a:z], num, den)
                if not len(left):
                    continue
                if dense is not None and len(left) * cols["blocks"][a] > dense * (z - a):
                    best = best_of_each(left, right, score)
                    left, right = left[best], right[best]
                    found.append((k[a : a + 1], k[a : a + 1], np.ones(1, bool)))
                else:
                    lower = {}
                    for m in np.unique(np.concatenate([left, right])):
                        keys = lists[int(m)].values.to_numpy()
                        lower[int(m)] = set(keys[: int(np.searchsorted(keys, k[a]))].tolist())
                    first = np.array([lower[x].isdisjoint(lower[y]) for x, y in zip(left.tolist(), right.tolist())], bool)
                    left, right = left[first], right[first]
                x, y = cols["cid"][left], cols["cid"][right]
                found.append((np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), bool)))
            none = [np.zeros(0, np.int64)]
            a, b, more = (np.concatenate([f[x] for f in found] or none) for x in range(3))
            return pa.RecordBatch.from_arrays([_long(a.astype(np.int64)), _long(b.astype(np.int64)), pa.array(more.astype(bool))], names=["a", "b", "dense"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            k, i, j = (t.column(x).to_numpy() for x in ("key", "i", "j"))
            other = np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            rest = t.slice(cut)  # one unit at most: two blocks
            if cut:
                yield pairs(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    # dealt by a number that no plan below is partitioned by: else the optimizer may drop the exchange
    dealt = full.repartition(F.xxhash64("key", "i", "j")).sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, dense boolean")


def grouped_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, tid, cid, n_shingles) of all rows, and the whole sets that share a group; both written."""
    with arrow_batches(docs.sparkSession):
        sets = materialize(keyed_sets(docs.select("doc_id", "text"), n, num, den), "join-keys")
        members = materialize(sets.select("doc_id", "tid", "cid", "n_shingles"), "join-members")
        units = materialize(units_of(sets.select("cid", "keys"), members), "join-units")
        drop_table(sets)  # the keys are the largest table, and done with
        whole = materialize(whole_sets(docs, units, n), "join-sets")
    drop_table(units)
    return members, whole


def set_components(whole: DataFrame, num: int, den: int) -> DataFrame:
    """cid, comp for every set that links with another; ``whole`` is deleted."""
    with arrow_batches(whole.sparkSession):
        near = materialize(star_candidates(whole, num, den), "join-stars")
    links = materialize(verified(near, whole, num, den), "join-links")
    drop_table(near)
    labels, only, dense = roots(links), None, DENSE
    while True:
        with arrow_batches(whole.sparkSession):
            pairs = materialize(tree_candidates(whole, labels, num, den, dense, only), "join-pairs")
        found = materialize(verified(pairs.filter("not dense").select("a", "b"), whole, num, den), "join-links")
        # a root for each class and the links between classes: pairs inside a class are never made
        arcs = labels.select(F.col("cid").alias("a"), F.col("comp").alias("b")).unionByName(found)
        new = components(arcs)
        again = pairs.filter("dense").select(F.col("a").alias("key")).distinct()
        left = dense is not None and not again.isEmpty()
        only = materialize(again, "join-dense") if left else None
        for old in (pairs, found, links, labels):
            drop_table(old)
        labels, dense = new, None
        if not left:
            break
    drop_table(whole)
    return labels


def links(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_links of every row of ``docs``: with how many other rows it links, those of an equal set included.

    Every pair of distinct sets that share a group is verified: neither leaders nor classes cut the
    traversal, so the work follows the number of links.
    """
    members, whole = grouped_sets(docs, n, num, den)
    with arrow_batches(docs.sparkSession):
        candidates = materialize(tree_candidates(whole, None, num, den, None), "join-pairs")
    pairs = materialize(verified(candidates, whole, num, den), "join-links")
    drop_table(candidates)
    drop_table(whole)
    rows = members.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("rows"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(rows.select(F.col("cid").alias("b"), "rows"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("rows").alias("far"))
    counts = rows.join(far, "cid", "left").select("cid", (F.col("rows") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    linked_rows = members.filter("cid is not null").join(counts, "cid").select("doc_id", "n_links")
    return linked_rows.unionByName(members.filter("cid is null").select("doc_id", F.lit(0).cast("long").alias("n_links")))


def join(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    members, whole = grouped_sets(docs, n, num, den)
    rows = labelled(members.filter("cid is not null"), set_components(whole, num, den), "cid", "comp")
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "comp").select("doc_id", "n_shingles", "component_id")
    alone = members.filter("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged: the least doc_id, null last.

    Rows without words are linked with nothing and all stay. Rows equal in doc_id and text are one
    document: any one of them stays. Only rows that the filter of those to drop hits are shuffled.
    """
    columns = docs.columns
    members, whole = grouped_sets(docs, n, num, den)
    rows = labelled(members.filter("cid is not null"), set_components(whole, num, den), "cid", "comp")
    rows = materialize(rows.select("comp", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tid").alias("row")), "join-rows")
    first = rows.groupBy("comp").agg(F.min("row").alias("first"))
    first = materialize(first, "join-first")
    rid = row_number_of(F.col("doc_id"), F.col("tid"))
    late = materialize(rows.join(first, "comp").filter("row <> first").select("row.doc_id", "row.tid").withColumn("rid", rid), "join-late")
    dropped = late.count()
    words, shift = filter_of(late, dropped)
    marked = docs.select(F.struct(*columns).alias("__j_row"), F.col("doc_id").cast("long").alias("__j_doc"), F.xxhash64(text_or_empty()).alias("__j_tid"))
    marked = marked.withColumn("__j_rid", row_number_of(F.col("__j_doc"), F.col("__j_tid"))).withColumn("__f_word", F.shiftrightunsigned("__j_rid", shift))
    marked = marked.join(F.broadcast(words), "__f_word", "left").withColumn("__j_hit", hit(F.col("__j_rid")))
    same = (F.col("__j_rid") == F.col("rid")) & (F.col("__j_tid") == F.col("tid")) & F.col("__j_doc").eqNullSafe(F.col("doc_id"))
    asked = marked.filter("__j_hit").join(late.select("rid", "tid", "doc_id"), same, "left_anti")
    kept = marked.filter("not __j_hit").select("__j_row", "__j_doc", "__j_tid").unionByName(asked.select("__j_row", "__j_doc", "__j_tid"))
    if rows.count() > dropped + first.count():  # only then has a component kept several equal rows
        worded = F.btrim(F.col("__j_row.text").cast("string"), F.lit(BLANKS)) != ""
        blank = kept.filter(~F.coalesce(worded, F.lit(False)))
        kept = kept.filter(worded).dropDuplicates(["__j_doc", "__j_tid"]).unionByName(blank)
    return kept.select(*[F.col("__j_row")[c].alias(c) for c in columns])
