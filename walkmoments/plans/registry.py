"""Registered graph queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that must agree.

Names follow the operators; README.md maps them to the operator inventory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import direction_class, integer_hash, relative, tidy
from ..operators import additions, bank, deltas, fingerprint, graph, incremental, moments, reporting, sampling, search, spectral, stats
from ..operators.graph import Graph
from ..operators.lineage import cut, shared_folder
from ..sources import files, graphs
from . import sql as S

_found: dict[str, tuple[Callable, str | Callable[[], str] | None]] = {}


def query(oracle: str | Callable[[], str] | None = None):
    def keep(f: Callable) -> Callable:
        _found[f.__name__] = (f, oracle)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text() if callable(text) else text for name, (_, text) in _found.items() if text is not None}


def rounded(df: DataFrame, digits: int = 12) -> DataFrame:
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ST1, ST2, ST4 = S.stats("handover"), S.stats("copurchase"), S.stats("stars")
R = S.r


def labelled_nodes(g: Graph) -> DataFrame:
    return g.nodes().select("id", F.pmod("id", F.lit(5)).cast("int").alias("label"), (F.pmod("id", F.lit(3)) == 0).alias("train"))


LAB = "lab as (select id, cast(id % 5 as int) label, id % 3 = 0 train from ids)"


# -- files and the registry of graphs ---------------------------------------------------------------


def _file(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


@query(f"with {S.G1} select u, v from g")
def edge_list_file(spark, sf):
    path = _file(spark, f"edges-{uuid.uuid4().hex}.csv")
    graphs.handover(spark, sf).edges.write.csv(path)
    return files.read_edges(spark, path)


@query(
    f"with {S.G4}, i as (select id, row_number() over (order by id) - 1 x from (select u id from g union select v from g)) "
    "select least(p.x, q.x) u, greatest(p.x, q.x) v from g join i p on p.id = g.u join i q on q.id = g.v"
)
def relabelled_edge_list(spark, sf):
    """A gzip file with ids far apart, loops and repeats, read with dense ids."""
    path = _file(spark, f"raw-{uuid.uuid4().hex}")
    e = graphs.stars(spark, sf).edges.select((F.col("u") * 7 + 3).alias("u"), (F.col("v") * 7 + 3).alias("v"))
    raw = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(e.select("u", F.col("u").alias("v")))
    raw.select(F.concat_ws("\t", "u", "v").alias("value")).write.option("compression", "gzip").text(path)
    return files.read_relabelled(spark, path).edges


@query(f"with {S.G1} select u, v from g")
def graph_by_name(spark, sf):
    return graphs.load(spark, sf, "Hand-Over").edges


@query(f"with {S.G1} select 0 step, u, v from g union all select 1, u, v from g where u % 2 = 0")
def snapshot_files(spark, sf):
    path = _file(spark, f"snapshots-{uuid.uuid4().hex}")
    e = graphs.handover(spark, sf).edges
    both = e.select(F.lit(0).alias("step"), "u", "v").unionByName(e.filter("u % 2 = 0").select(F.lit(1).alias("step"), "u", "v"))
    files.write_snapshots(both, spark.createDataFrame([(0, 2, 0.5)], "step int, k int, m double"), path)
    return files.read_snapshots(spark, path)[0].select("step", "u", "v")


# -- canonical forms, filters, set operations ------------------------------------------------------


@query(f"with {S.G1} select u, v from g")
def canonical_edges(spark, sf):
    return graphs.handover(spark, sf).edges


@query(f"with {S.G2} select u, v from g")
def strict_edges(spark, sf):
    g = graphs.copurchase(spark, sf)
    return graph.canonical(g.edges.select(F.col("v").alias("u"), F.col("u").alias("v")), g.n).edges


@query(f"with {S.G2} select u src, v dst from g union all select v, u from g")
def arcs(spark, sf):
    return graphs.copurchase(spark, sf).arcs()


@query(f"with {S.G1}, {S.IDS} select a.id u, b.id v from ids a join ids b on a.id < b.id anti join g on g.u = a.id and g.v = b.id")
def complement_edges(spark, sf):
    return graph.complement(graphs.handover(spark, sf))


@query(f"with {S.G3} select u, v from g")
def bipartite_edges(spark, sf):
    return graphs.supply(spark, sf).edges


@query(f"with {S.G5} select u, v from g")
def trade_edges(spark, sf):
    return graphs.trade(spark, sf).edges


@query(
    f"with {S.G1}, {S.IDS}, {LAB} select 'same' pool, u, v from g join lab a on a.id = u join lab b on b.id = v where a.label = b.label "
    "union all select 'cross', u, v from g join lab a on a.id = u join lab b on b.id = v where a.label <> b.label "
    "union all select 'train', u, v from g join lab a on a.id = u join lab b on b.id = v where not (a.label = b.label and a.train and b.train)"
)
def protected_pools(spark, sf):
    g = graphs.handover(spark, sf)
    nodes = labelled_nodes(g)
    same = graph.deletable(g.edges, nodes, same_label_only=True).select(F.lit("same").alias("pool"), "u", "v")
    cross = graph.deletable(g.edges, nodes, protect_same_label=True).select(F.lit("cross").alias("pool"), "u", "v")
    return same.unionByName(cross).unionByName(graph.deletable(g.edges, nodes, protect_train_same_label=True).select(F.lit("train").alias("pool"), "u", "v"))


@query(
    f"with {S.G1}, {S.IDS}, {LAB} select u, v from g join lab a on a.id = u join lab b on b.id = v where a.label = b.label and (u + v) % 2 = 0"
)
def whitelisted_deletions(spark, sf):
    g = graphs.handover(spark, sf)
    return graph.deletable(g.edges, labelled_nodes(g), same_label_only=True, allowed=g.edges.filter("(u + v) % 2 = 0"))


@query(
    f"with {S.G1}, {S.IDS}, {LAB} select a.id u, b.id v from lab a join lab b on a.id < b.id and a.label <> b.label anti join g on g.u = a.id and g.v = b.id"
)
def addable_pairs(spark, sf):
    g = graphs.handover(spark, sf)
    return graph.addable(graph.complement(g), labelled_nodes(g), diff_label_only=True)


HASH = "((u * 73856093 + v * 19349663 + {0} * 83492791) % 1000003)"


@query(f"with {S.G2} select u, v from g where {HASH.format(7)} >= 300000")
def bernoulli_edge_drop(spark, sf):
    g = graphs.copurchase(spark, sf)
    return graph.drop_edges(g.edges, integer_hash(F.col("u"), F.col("v"), 7) >= 300000)


@query(f"with {S.G2} select u, v from g where u % 3 <> 0 and v % 3 <> 0")
def induced_subgraph(spark, sf):
    g = graphs.copurchase(spark, sf)
    return graph.induced(g.edges, g.nodes().filter("id % 3 <> 0"))


@query(
    f"with {S.G1}, c as (select count(*) e from g) select r.ratio, cast(ceil(round(r.ratio * e, 9)) as bigint) budget from c, (values (0.05::double), (0.1::double), (0.15::double), (0.3::double)) r(ratio)"
)
def local_budgets(spark, sf):
    size = graphs.handover(spark, sf).edges.count()
    ratios = [0.05, 0.1, 0.15, 0.3]
    return spark.createDataFrame(list(zip(ratios, reporting.budgets(size, ratios))), "ratio double, budget long")


# -- node and pair statistics ----------------------------------------------------------------------


@query(f"with {ST2} select id, cast(d as bigint) d, {R('case when d > 0 then 1.0 / d else 0.0 end', 'inv_d')} from ns")
def degree_stats(spark, sf):
    from ..functions import inverse

    return rounded(stats.all_degrees(graphs.copurchase(spark, sf)).withColumn("inv_d", inverse(F.col("d"))))


@query(f"with {ST2} select wt.id, {R('w', 'w')} from wt")
def neighbor_inverse_degree(spark, sf):
    return rounded(stats.neighbour_mass(graphs.copurchase(spark, sf)).select("id", F.col("W").alias("w")))


@query(f"with {ST2} select id, {R('h', 'h')} from ht")
def node_triangle_mass(spark, sf):
    return rounded(stats.triangle_mass(stats.triangles(graphs.copurchase(spark, sf))).select("id", F.col("H").alias("h")))


@query(f"with {ST2} select u, v, {R('m', 'm')} from em")
def edge_common_neighbor_mass(spark, sf):
    return rounded(stats.edge_mass(stats.triangles(graphs.copurchase(spark, sf))))


@query(f"with {ST2} select least(a, b, c) a, a + b + c - least(a, b, c) - greatest(a, b, c) b, greatest(a, b, c) c from tri")
def triangles(spark, sf):
    t = stats.triangles(graphs.copurchase(spark, sf))
    low, high = F.least("a", "b", "c"), F.greatest("a", "b", "c")
    return t.select(low.alias("a"), (F.col("a") + F.col("b") + F.col("c") - low - high).alias("b"), high.alias("c"))


@query(f"with {ST1}, {S.ADD} select p.u, p.v, {R('pm.m', 'm')} from pairs p join pm on pm.u = p.u and pm.v = p.v")
def pair_common_neighbor_mass(spark, sf):
    g = graphs.handover(spark, sf)
    return rounded(stats.apart_mass(g))


# -- moments and properties ------------------------------------------------------------------------


def _moments_sql(graph_name: str, orders, digits: int = 12) -> str:
    top = max([-(-k // 2) for k in orders if k > 3] or [1])
    rows = " union all ".join(f"select {k} k, {R(S.moment(k), 'm', digits)}" for k in orders)
    return f"with {S.stats(graph_name)}, {S.walks(top)} {rows}"


@query(_moments_sql("copurchase", (1, 2, 3, 4)))
def moments_m1_m4(spark, sf):
    return rounded(moments.moment_rows(graphs.copurchase(spark, sf), (1, 2, 3, 4)))


@query(_moments_sql("handover", (2, 3, 4, 5, 6)))
def moments_high_orders(spark, sf):
    return rounded(moments.moment_rows(graphs.handover(spark, sf), (2, 3, 4, 5, 6)))


@query(_moments_sql("supply", (2, 3)))
def moments_bipartite(spark, sf):
    return rounded(moments.moment_rows(graphs.supply(spark, sf), (2, 3)))


@query(_moments_sql("trade", (2, 3, 4, 5)))
def moments_complete(spark, sf):
    return rounded(moments.moment_rows(graphs.trade(spark, sf), (2, 3, 4, 5)))


SYNTH = [("complete", 12), ("path", 9), ("cycle", 10), ("star", 8), ("lollipop", 10), ("friendship", 41), ("tree", 31), ("house", 5), ("bull", 5)]


@query(
    "select k, graph, round(m, 12) + 0.0 as m from (select k, 'complete' graph, (1 + 11 * power(-1.0 / 11, k)) / 12 m from (values (2), (3), (4)) t(k) "
    "union all select k, 'cycle', case k when 2 then 0.5 when 3 then 0.0 else 0.375 end from (values (2), (3), (4)) t(k) "
    "union all select k, 'star', case when k % 2 = 0 then 0.25 else 0.0 end from (values (2), (3), (4)) t(k))"
)
def synthetic_moments(spark, sf):
    out = None
    for kind, n in (("complete", 12), ("cycle", 10), ("star", 8)):
        rows = moments.moment_rows(graphs.synthetic(spark, kind, n), (2, 3, 4)).select("k", F.lit(kind).alias("graph"), "m")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@query(
    "select graph, cast(u as bigint) u, cast(v as bigint) v from ("
    "select 'complete' graph, a.range u, b.range v from range(12) a, range(12) b where a.range < b.range union all select 'path', range, range + 1 from range(8) "
    "union all select 'cycle', range, range + 1 from range(9) union all select 'cycle', 0, 9 union all select 'star', 0, range from range(1, 8) "
    "union all select 'lollipop', a.range, b.range from range(5) a, range(5) b where a.range < b.range union all select 'lollipop', range, range + 1 from range(4, 9) "
    "union all select 'friendship', 0, 2 * range + 1 from range(20) union all select 'friendship', 0, 2 * range + 2 from range(20) union all select 'friendship', 2 * range + 1, 2 * range + 2 from range(20) "
    "union all select 'tree', range, 2 * range + 1 from range(15) union all select 'tree', range, 2 * range + 2 from range(15) "
    "union all select 'house', * from (values (0, 1), (1, 2), (2, 3), (0, 3), (2, 4), (3, 4)) union all select 'bull', * from (values (0, 1), (1, 2), (0, 2), (0, 3), (1, 4)))"
)
def synthetic_edges(spark, sf):
    out = None
    for kind, n in SYNTH:
        rows = graphs.synthetic(spark, kind, n).edges.select(F.lit(kind).alias("graph"), "u", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {ST1} select {R('(select sum(w / d) from ns where d > 0) / n', 'm2')}, {R('2 * (select sum(h / d) from ns where d > 0) / n', 'm3')} from nn")
def state_moments(spark, sf):
    g = graphs.handover(spark, sf)
    rows = stats.node_stats(g).filter("d > 0")
    n = float(g.n)
    return rounded(rows.agg((F.sum(F.col("W") / F.col("d")) / n).alias("m2"), (2 * F.sum(F.col("H") / F.col("d")) / n).alias("m3")))


@query(f"with {ST1}, {S.walkers(20000, 4, 11, S.drawn(11, 'id', '0'))} " + " union all ".join(f"select {k} k, (select count(*) filter (where start = now) from st{k}) / 20000.0::double m" for k in range(1, 5)))
def monte_carlo_moments(spark, sf):
    return moments.monte_carlo(graphs.handover(spark, sf), 20_000, 4, 11)


@query(f"with {ST2} select {R('(select sum(w / d) from ns where d > 0) / n', 'value')} from nn")
def avg_neighbor_inv_degree(spark, sf):
    return rounded(moments.average_neighbour_inverse_degree(graphs.copurchase(spark, sf)))


CLUSTER = "(case when d >= 2 then coalesce(s, 0.0) / (d * (d - 1) / 2) else 0.0 end)"


@query(f"with {ST2}, cs as (select id, sum(1.0 / sqrt(dx * dy)) s from corner group by id) select ns.id, {R(CLUSTER, 'c')} from ns left join cs on cs.id = ns.id")
def clustering_weighted(spark, sf):
    return rounded(moments.weighted_clustering(graphs.copurchase(spark, sf).cached()))


@query(f"with {ST1} select {R('abs((select avg(d) from ns) - (select avg(d) from ns where id % 2 = 0))', 'value')}")
def mean_difference(spark, sf):
    d = stats.all_degrees(graphs.handover(spark, sf))
    return rounded(moments.absolute_mean_difference(d, d.filter("id % 2 = 0"), "d"))


@query(f"with {ST2} select id from ns where d = 0")
def isolated_nodes(spark, sf):
    return moments.isolated(graphs.copurchase(spark, sf))


@query(
    f"with recursive {S.G4}, {S.IDS}, arcs as (select u src, v dst from g union all select v, u from g), "
    "reach(id, r) as (select id, id from ids union select dst, r from reach join arcs on src = reach.id) select id, min(r) component from reach group by id"
)
def connected_components(spark, sf):
    return spectral.components(graphs.stars(spark, sf))


# -- moment changes --------------------------------------------------------------------------------


@query(f"with {ST2}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def delete_delta_m2_m3(spark, sf):
    return rounded(deltas.delete_deltas(graphs.copurchase(spark, sf)))


def _edited_sql() -> str:
    """The statistics of the hand-over graph after the edits of EDITS, as ``g``."""
    first = S.G1.replace("g as (", "first as (", 1)
    edits = EDITS.replace("from g ", "from first ").replace("anti join g on g.u = a.id and g.v = b.id", "anti join first f on f.u = a.id and f.v = b.id")
    rest = ST1[len(S.G1) :]
    return f"{first}, {S.IDS}, {edits}, g as (select u, v from first anti join del using (u, v) union all select u, v from come){rest.replace(S.IDS + ',', '', 1)}"


@query(lambda: f"with {_edited_sql()}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def maintained_deletion_deltas(spark, sf):
    """Changes of all deletions after a batch of edits, from statistics that only the edits' surroundings renew."""
    g = graphs.handover(spark, sf).cached()
    return rounded(incremental.MaintainedGraph.of(g).apply(*_edits(g)).deletion_deltas())


@query(f"with {ST1}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def delta_file(spark, sf):
    """The changes as one CSV file, read back."""
    path = _file(spark, f"deltas-{uuid.uuid4().hex}.csv")
    files.write_deltas(rounded(deltas.delete_deltas(graphs.handover(spark, sf))), path)
    return spark.read.csv(path, header=True, schema="u long, v long, delta_m2 double, delta_m3 double")


@query(f"with {ST4}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def delete_delta_leaf(spark, sf):
    return rounded(deltas.delete_deltas(graphs.stars(spark, sf)))


@query(f"with {ST1}, {S.ADD} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from adds")
def add_delta_m2_m3(spark, sf):
    return rounded(deltas.add_deltas(graphs.handover(spark, sf)))


@query(f"with {ST1}, {S.walks(5)}, {S.walk_deltas('g', 5, False)} select u, v, {R('p4 / n', 'delta_m4')}, {R('p5 / n', 'delta_m5')} from wd")
def delete_delta_m4_m5(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(deltas.walk_deltas(g, g.edges, (4, 5)))


@query(f"with {ST1}, pairs as (select a.id u, b.id v from ids a join ids b on a.id < b.id anti join g on g.u = a.id and g.v = b.id), {S.walks(4)}, {S.walk_deltas('pairs', 4, True)} select u, v, {R('p4 / n', 'delta_m4')} from wd")
def add_delta_m4(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(deltas.all_addition_deltas(g, (4,)))


@query(f"with {ST1}, {S.DELETE}, {S.walks(4)}, {S.walk_deltas('g', 4, False)} select d.u, d.v, {R('d.d2', 'delta_m2')}, {R('d.d3', 'delta_m3')}, {R('p4 / wd.n', 'delta_m4')} from dels d join wd on wd.u = d.u and wd.v = d.v")
def hybrid_deltas(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(deltas.deletion_deltas(g, (2, 3, 4), "hybrid"))


EDITS = "del as (select u, v from g order by u, v limit 3), come as (select a.id u, b.id v from ids a join ids b on a.id < b.id anti join g on g.u = a.id and g.v = b.id order by u, v limit 2)"
AFTER = "g2 as (select u, v from g anti join del using (u, v) union all select u, v from come)"


def _edits(g: Graph) -> tuple[DataFrame, DataFrame]:
    return cut(graph.first_non_edges(g, 2)), cut(g.edges.orderBy("u", "v").limit(3))


def _after(name: str) -> str:
    """Moments 2 and 3 of table ``name``."""
    return (
        f"a_{name} as (select u s, v t from {name} union all select v, u from {name}), d_{name} as (select s id, cast(count(*) as double) d from a_{name} group by s), "
        f"m_{name} as (select (select sum(2.0 / (p.d * q.d)) from {name} e join d_{name} p on p.id = e.u join d_{name} q on q.id = e.v) / n m2, "
        f"coalesce((select sum(6.0 / (p.d * q.d * r.d)) from {name} x join {name} y on x.v = y.u join {name} z on z.u = x.u and z.v = y.v "
        f"join d_{name} p on p.id = x.u join d_{name} q on q.id = x.v join d_{name} r on r.id = y.v), 0.0) / n m3 from nn)"
    )


@query(f"with {S.G1}, {S.IDS}, {EDITS}, {AFTER}, {_after('g')}, {_after('g2')} select 2 k, {R('b.m2 - a.m2', 'delta')} from m_g a, m_g2 b union all select 3, {R('b.m3 - a.m3')} from m_g a, m_g2 b")
def joint_edit_delta(spark, sf):
    g = graphs.handover(spark, sf).cached()
    found = deltas.joint_delta_low_rank(g, *_edits(g), (2, 3))
    return rounded(spark.createDataFrame(sorted(found.items()), "k int, delta double"))


@query(
    f"with {S.G1}, {S.IDS}, {EDITS}, {AFTER}, t as (select u t from del union select v from del union select u from come union select v from come), "
    "a as (select u s, v d from g union all select v, u from g), b as (select u s, v d from g2 union all select v, u from g2), "
    "old as (select d i, s t, 1.0 / count(*) over (partition by s) w from a where s in (select t from t)), new as (select d i, s t, 1.0 / count(*) over (partition by s) w from b where s in (select t from t)) "
    f"select i, t, {R('coalesce(new.w, 0.0) - coalesce(old.w, 0.0)', 'w')} from old full join new using (i, t) where coalesce(new.w, 0.0) <> coalesce(old.w, 0.0)"
)
def low_rank_update(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(deltas.transition_update(g, *_edits(g)))


@query(f"with {ST1}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def moment_delta_calculator(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(deltas.MomentDeltaCalculator.from_undirected_edges(g.edges, g.n).deletion_deltas(orders=(2, 3), backend="topology"))


@query(f"with {ST1}, {S.DELETE} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels")
def direct_trace_deltas(spark, sf):
    return rounded(deltas.direct_deltas_all(graphs.handover(spark, sf).cached(), (2, 3)))


# -- directions, scores, choices -------------------------------------------------------------------

REL = "rel as (select u, v, d2 / greatest(abs(m2), 1e-12) x, d3 / greatest(abs(m3), 1e-12) y, d2, d3, m2, m3 from dels, mm)"
MM = f"mm as (select {S.moment(2)} m2, {S.moment(3)} m3)"
ANGLE = "(case when atan2(y, x) < 0 then atan2(y, x) + 2 * pi() else atan2(y, x) end)"
SECTOR = f"cast(cast(floor({ANGLE} * 8 / (2 * pi()) + 0.5) as bigint) % 8 as int)"


def _relatives(g: Graph) -> DataFrame:
    state = deltas.prepare(g)
    m, rows = state.moments, deltas.delete_deltas(g, state=state)
    return rows.withColumn("rel_m2", relative(F.col("delta_m2"), m[2])).withColumn("rel_m3", relative(F.col("delta_m3"), m[3]))


@query(f"with {ST2}, {S.DELETE}, {MM}, {REL} select u, v, {SECTOR} direction from rel")
def direction_classes(spark, sf):
    rows = _relatives(graphs.copurchase(spark, sf).cached())
    return rows.select("u", "v", direction_class(F.col("rel_m2"), F.col("rel_m3"), 8).alias("direction"))


@query(
    f"with {ST1}, {S.DELETE}, {MM}, {REL}, c as (select u, v, x, y, {SECTOR} direction from rel), e as (select cast(range as int) direction from range(8)) "
    f"select e.direction, count(c.u) edges, count(c.u) filter (where (c.u + c.v) % 2 = 0) kept, {R('avg(x)', 'mean_rel_m2')}, {R('avg(y)', 'mean_rel_m3')} from e left join c using (direction) group by e.direction"
)
def direction_class_stats(spark, sf):
    rows = _relatives(graphs.handover(spark, sf).cached())
    rows = rows.withColumn("direction", direction_class(F.col("rel_m2"), F.col("rel_m3"), 8))
    return rounded(reporting.class_stats(rows, rows.filter("(u + v) % 2 = 0"), 8))


@query(
    f"with {ST1}, {S.DELETE}, {MM}, {REL}, p as (select *, (x + y) / sqrt(2.0) gain, abs(y - x) / sqrt(2.0) orthogonal, sqrt(x * x + y * y) length from rel) "
    f"select u, v, {R('gain', 'gain', 9)}, {R('orthogonal', 'orthogonal', 9)}, {R('length', 'length', 9)}, {R('case when length > 1e-12 then gain / length end', 'cosine', 6)} from p"
)
def direction_records(spark, sf):
    g = graphs.handover(spark, sf).cached()
    rows = search.direction_record(deltas.delete_deltas(g), moments.compute_moments(g, (2, 3)), 1.0, 1.0)
    return rows.select("u", "v", *[tidy(F.col(c), d).alias(c) for c, d in (("gain", 9), ("orthogonal", 9), ("length", 9), ("cosine", 6))])


SCORE = "sqrt(power(d2 / (case when abs(m2) > 1e-12 then abs(m2) else 1.0 end), 2) + power(d3 / (case when abs(m3) > 1e-12 then abs(m3) else 1.0 end), 2))"


def _scored(g: Graph, euclidean: bool = False) -> DataFrame:
    state = deltas.prepare(g)
    m = state.moments
    rows = deltas.delete_deltas(g, state=state).withColumn("op_rank", F.lit(1))
    return search.scored(rows, m, m, search.relative_scale(m), m if euclidean else None, euclidean)


@query(f"with {ST1}, {S.DELETE}, {MM} select u, v, {R(SCORE, 'distance', 10)} from dels, mm")
def target_distances(spark, sf):
    return _scored(graphs.handover(spark, sf).cached(), euclidean=True).select("u", "v", tidy(F.col("score"), 10).alias("distance"))


@query(f"with {ST2}, {S.DELETE}, {MM} select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from dels, mm order by round({SCORE}, 12), u, v limit 1")
def best_deletion(spark, sf):
    return rounded(search.best(_scored(graphs.copurchase(spark, sf).cached())).select("u", "v", "delta_m2", "delta_m3"))


@query(f"with {ST1}, {S.DELETE}, {MM} select u, v, {R(SCORE, 'distance', 10)} from dels, mm order by round({SCORE}, 12), u, v limit 25")
def topk_deletions(spark, sf):
    return search.best(_scored(graphs.handover(spark, sf).cached()), 25).select("u", "v", tidy(F.sqrt("score"), 10).alias("distance"))


@query(f"with {ST4}, {S.DELETE}, {MM} select u, v from dels, mm order by round({SCORE}, 12), u, v limit 1")
def best_deletion_of_ties(spark, sf):
    return search.best(_scored(graphs.stars(spark, sf).cached())).select("u", "v")


BOTH = "edits as (select 'add' op, 0 o, u, v, d2, d3 from adds union all select 'delete', 1, u, v, d2, d3 from dels)"


@query(f"with {ST1}, {S.DELETE}, {S.ADD}, {MM}, {BOTH} select op, u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from edits, mm order by round({SCORE}, 12), o, u, v limit 1")
def best_mixed_edit(spark, sf):
    rows = search.best_mixed(graphs.handover(spark, sf).cached())
    return rounded(rows.select("op", "u", "v", "delta_m2", "delta_m3"))


def _best_addition(g: Graph, **how) -> DataFrame:
    rows = additions.features(g)
    m = additions.moments_of(rows, g.n)
    return rounded(additions.best_addition(g, m, {2: 0.98 * m[2], 3: 1.05 * m[3]}, search.relative_scale(m), rows=rows, **how))


NEARER = "round(sqrt(power((d2 + 0.02 * m2) / m2, 2) + power((d3 - 0.05 * m3) / (case when m3 > 1e-12 then m3 else 1.0 end), 2)), 12)"
NEAREST = f"select u, v, {R('d2', 'delta_m2')}, {R('d3', 'delta_m3')} from adds, mm order by {NEARER}, u, v limit 1"


@query(f"with {ST1}, {S.ADD}, {MM} {NEAREST}")
def best_addition(spark, sf):
    return _best_addition(graphs.handover(spark, sf).cached())


@query(f"with {S.stats('supply')}, {S.ADD}, {MM} {NEAREST}")
def best_addition_by_grids(spark, sf):
    """Through every grid, whatever the number of classes; two sides, so that few pairs have common neighbours."""
    return _best_addition(graphs.supply(spark, sf).cached(), direct=0)


@query(f"with {ST1}, {S.DELETE}, {S.ADD}, {MM}, {BOTH} select op, u, v from edits, mm order by round(-d2 / m2 + 0.5 * d3 / m3, 12) desc, o, u, v limit 1")
def directional_edit(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return search.best_directional(g, moments.compute_moments(g, (2, 3)), -1.0, 0.5).select("op", "u", "v")


@query(
    f"with {ST1}, {S.DELETE}, {S.ADD}, {MM}, {BOTH}, r as (select op, o, u, v, (d2 / m2 + d3 / m3) / sqrt(2.0) gain, abs(d3 / m3 - d2 / m2) / sqrt(2.0) drift, sqrt(power(d2 / m2, 2) + power(d3 / m3, 2)) l from edits, mm) "
    "select op, u, v from r where gain > 0 and gain / l >= 0.5 order by round(gain - drift, 12) desc, o, u, v limit 1"
)
def ray_constrained_edit(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return search.ray_constrained(search.edit_candidates(g, "mixed"), moments.compute_moments(g, (2, 3)), 1.0, 1.0, 0.0, 0.5).select("op", "u", "v")


@query(f"with {ST1}, {S.DELETE} select {R('stddev_pop(d2)', 's2')}, {R('stddev_pop(d3)', 's3')} from dels")
def std_normalizer(spark, sf):
    found = search.std_scale(deltas.delete_deltas(graphs.handover(spark, sf)), (2, 3))
    return rounded(spark.createDataFrame([(found[2], found[3])], "s2 double, s3 double"))


@query(f"with {ST1}, {MM} select {R('abs(m2)', 's2')}, {R('abs(m3)', 's3')} from mm")
def graph_relative_scale(spark, sf):
    found = search.relative_scale(moments.compute_moments(graphs.handover(spark, sf), (2, 3)))
    return rounded(spark.createDataFrame([(found[2], found[3])], "s2 double, s3 double"))


@query(
    f"with {ST1}, {MM}, p as (select i * 4 + j target_id, least(greatest(m2 * 0.5 + i * m2 / 4, 0), 1) m2, least(greatest(m3 * 0.5 + j * m3 / 3, 0), 0.25) m3 "
    f"from mm, (select range i from range(5)) a, (select range j from range(4)) b) select target_id, {R('m2', 'm2')}, {R('m3', 'm3')} from p where m3 <= m2 union all select 20, {R('m2')}, {R('m3')} from mm"
)
def target_grid(spark, sf):
    m = moments.compute_moments(graphs.handover(spark, sf), (2, 3))
    return rounded(search.target_grid(spark, m[2], m[3], 5, 4, 0.5))


@query(
    f"with {ST1}, {MM}, p as (select i * 4 + j target_id, least(greatest(m2 * 0.5 + i * m2 / 4, 0), 1) m2, least(greatest(m3 * 0.5 + j * m3 / 3, 0), 0.25) m3 "
    "from mm, (select range i from range(5)) a, (select range j from range(4)) b), e as (select count(*) c from g) "
    f"select 'target_' || lpad(cast(target_id as varchar), 3, '0') point_id, target_id, {R('m2', 'target_m2')}, {R('m3', 'target_m3')}, cast(round_even(c * 0.1::double, 0) as bigint) add_budget, "
    "cast(round_even(c * 0.2::double, 0) as bigint) delete_budget, cast(round_even(c * 0.1::double, 0) + round_even(c * 0.2::double, 0) as bigint) total_budget from p, e where m3 <= m2 and target_id in (0, 5, 10, 15)"
)
def target_points(spark, sf):
    g = graphs.handover(spark, sf).cached()
    m = moments.compute_moments(g, (2, 3))
    return rounded(search.prepare_points(search.target_grid(spark, m[2], m[3], 5, 4, 0.5), g.edges.count(), [0, 5, 10, 15], add=0.1, delete=0.2))


# -- trajectories ----------------------------------------------------------------------------------


def _greedy_sql(steps: int, kept: tuple[int, ...] | None = None, top: int | None = None) -> str:
    """Greedy deletion unrolled: each step repeats the statistics on what is left. ``kept``: the edges after these steps.

    ``top``: the lazy rule, by which a step scores anew only so many edges, the best by the scores held so far.
    """
    ctes, edges = [S.G1, S.IDS, "g0 as (select u, v from g)", _after("g0")], "g0"
    for t in range(1, steps + 1):
        e = f"g{t - 1}"
        ctes.append(
            f"t{t} as (select x.u a, x.v b, y.v c, p.d da, q.d db, r.d dc from {e} x join {e} y on x.v = y.u join {e} z on z.u = x.u and z.v = y.v join d_{e} p on p.id = x.u join d_{e} q on q.id = x.v join d_{e} r on r.id = y.v), "
            f"w{t} as (select s id, sum(1.0 / d) w from a_{e} join d_{e} on id = t group by s), "
            f"c{t} as (select a id, b x, c y, da d, db dx, dc dy from t{t} union all select b, a, c, db, da, dc from t{t} union all select c, a, b, dc, da, db from t{t}), "
            f"h{t} as (select id, sum(1.0 / (dx * dy)) h from c{t} group by id), m{t} as (select least(x, y) u, greatest(x, y) v, sum(1.0 / d) m from c{t} group by 1, 2), "
            f"f{t} as (select e.u, e.v, p.d du, q.d dv, a.w wu, b.w wv, coalesce(h.h, 0) hu, coalesce(k.h, 0) hv, coalesce(m.m, 0) m from {e} e join d_{e} p on p.id = e.u join d_{e} q on q.id = e.v "
            f"join w{t} a on a.id = e.u join w{t} b on b.id = e.v left join h{t} h on h.id = e.u left join h{t} k on k.id = e.v left join m{t} m on m.u = e.u and m.v = e.v), "
            f"k{t} as (select f.u, f.v, now.m2 + (2.0 / n) * ((wu - 1.0 / dv) / {S.GAP.format('du')} + (wv - 1.0 / du) / {S.GAP.format('dv')} - 1.0 / (du * dv)) n2, "
            f"now.m3 + (6.0 / n) * ((hu - m / dv) / {S.GAP.format('du')} + (hv - m / du) / {S.GAP.format('dv')} - m / (du * dv)) n3 from f{t} f, nn, m_{e} now), "
            f"sc{t} as (select k.u, k.v, round(sqrt(power((n2 - z.m2) / z.m2, 2) + power((n3 - z.m3) / z.m3, 2)), 12) s from k{t} k, m_g0 z), "
            + (f"hd{t} as materialized (select u, v, s from sc1), " if top and t == 1 else "")
            + (f"po{t} as materialized (select u, v, sc{t}.s from (select u, v from hd{t} order by s, u, v limit {top}) join sc{t} using (u, v)), " if top else "")
            + f"b{t} as (select u, v from {f'po{t}' if top else f'sc{t}'} order by s, u, v limit 1), "
            + (f"hd{t + 1} as materialized (select h.u, h.v, coalesce(p.s, h.s) s from (select * from hd{t} anti join b{t} using (u, v)) h left join po{t} p on p.u = h.u and p.v = h.v), " if top else "") +
            f"g{t} as materialized (select u, v from {e} anti join b{t} using (u, v)), {_after(f'g{t}')}"
        )
        edges = f"g{t}"
    rows = " union all ".join(f"select {t} step, u, v from b{t}" for t in range(1, steps + 1))
    return f"with {', '.join(ctes)} {rows if kept is None else ' union all '.join(f'select {t} step, u, v from g{t}' for t in kept)}"


@query(_greedy_sql(3))
def greedy_delete(spark, sf):
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=3).edits.select("step", "u", "v")


@query(_greedy_sql(2))
def greedy_delete_relational(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return search.sample_by_moments(g.edges, g.n, budget=2, relational=True).edits.select("step", "u", "v")


@query()
def lazy_topk_delete(spark, sf):
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=20, strategy="lazy", orders=(2, 3, 4)).edits


@query(_greedy_sql(3))
def lazy_delete_all_refreshed(spark, sf):
    """With every candidate refreshed at each step the lazy search takes the greedy path."""
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=3, strategy="lazy", top_k=g.edges.count()).edits.select("step", "u", "v")


@query(_greedy_sql(2))
def lazy_delete_relational(spark, sf):
    """The lazy search as jobs; with every candidate refreshed it takes the greedy path."""
    g = graphs.handover(spark, sf).cached()
    return search.sample_by_moments(g.edges, g.n, budget=2, strategy="lazy", top_k=g.edges.count(), relational=True).edits.select("step", "u", "v")


@query(_greedy_sql(4, top=5))
def lazy_few_refreshed(spark, sf):
    """Only five edges a step are scored anew, the best by the scores held."""
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=4, strategy="lazy", top_k=5).edits.select("step", "u", "v")


@query(_greedy_sql(4, top=5))
def lazy_few_refreshed_relational(spark, sf):
    """The same as jobs over statistics that each step renews around its edit."""
    g = graphs.handover(spark, sf).cached()
    return search.sample_by_moments(g.edges, g.n, budget=4, strategy="lazy", top_k=5, relational=True).edits.select("step", "u", "v")


@query()
def mixed_trajectory(spark, sf):
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=6, operation="mixed", target={2: 0.04, 3: 0.006}, checkpoints=(0, 3, 6)).edits


@query(_greedy_sql(10, (0, 5, 10)))
def checkpoint_snapshots(spark, sf):
    g = graphs.handover(spark, sf)
    return search.sample_by_moments(g.edges, g.n, budget=10, checkpoints=(0, 5, 10)).snapshots


@query()
def graph_bank(spark, sf):
    g = graphs.handover(spark, sf)
    m = moments.compute_moments(g, (2, 3))
    grid = search.target_grid(spark, m[2], m[3], 3, 2, 0.3).collect()
    plans = {t * 4 + b: search.Plan(8, (2, 3), {2: r["m2"], 3: r["m3"]}, operation="mixed", candidate_limit=200, seed=5 + (t + 1) * 1_000_003 + b) for t, r in enumerate(grid) for b in range(4)}
    runs = spark.createDataFrame([(k,) for k in plans], "run_id int")
    return search.run_grouped(runs.join(g.edges), g.n, plans)  # every run has a copy of the small graph


@query(f"select cast(0 as bigint) target_id, cast(b.range as integer) bank_id, x.* from ({_greedy_sql(3)}) x, range(3) b")
def resumed_bank(spark, sf):
    """A bank at the graph's own moments, grown to one run and then, as a second job, to three."""
    g = graphs.handover(spark, sf).cached()
    m = moments.compute_moments(g, (2, 3))
    points = spark.createDataFrame([(0, m[2], m[3], 0, 3, 3)], "target_id long, target_m2 double, target_m3 double, add_budget long, delete_budget long, total_budget long")
    folder = f"{shared_folder(spark)}/bank-{uuid.uuid4().hex}"
    bank.grow_bank(g, points, folder, 1, operation="delete")
    runs = bank.grow_bank(g, points, folder, 3, operation="delete")
    return runs.select("target_id", "bank_id", F.explode("edits").alias("e")).select("target_id", "bank_id", "e.step", "e.u", "e.v")


@query()
def progressive_targets(spark, sf):
    g = graphs.handover(spark, sf)
    n = g.n
    if n > search.DENSE and 2 * g.edges.count() > search.TASK_ARCS:
        made = search.progressive_jobs(g.cached(), {2: 0.04, 3: 0.007}, 6, 3, 3)
        return spark.createDataFrame(made, "step int, op string, u long, v long")

    def run(key, rows):
        import numpy as np
        import pandas as pd

        pairs = rows[["u", "v"]].to_numpy(np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return pd.DataFrame(search.progressive(pairs, n, {2: 0.04, 3: 0.007}, 6, 3, 3), columns=["step", "op", "u", "v"])

    return g.edges.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(run, "step int, op string, u long, v long")


# -- sampling --------------------------------------------------------------------------------------


@query(f"with {S.G2} select u, v from g order by {HASH.format(3)}, u, v limit 500")
def candidate_subsample(spark, sf):
    return sampling.subsample(graphs.copurchase(spark, sf).edges, 500, 3)


@query(f"with {S.G1}, {S.IDS}, p as (select a.id u, b.id v from ids a join ids b on a.id < b.id anti join g on g.u = a.id and g.v = b.id) select u, v from p order by {HASH.format(5)}, u, v limit 300")
def non_edge_sample(spark, sf):
    return sampling.non_edges(graphs.handover(spark, sf), 300, 5)


@query(
    f"with {S.G2}, t as (select cast(n * (n - 1) / 2 as bigint) pairs from nn), dr as (select cast('0x' || substr(md5('5:' || range), 1, 15) as bigint) % pairs k, range draw from range(20000), t), "
    "f as (select k, min(draw) draw from dr group by k), v0 as (select k, draw, cast(floor((1 + sqrt(1 + 8.0 * k)) / 2) as bigint) v from f), "
    "v1 as (select k, draw, case when v * (v - 1) // 2 > k then v - 1 when v * (v + 1) // 2 <= k then v + 1 else v end v from v0), "
    "p as (select k - v * (v - 1) // 2 u, v, draw from v1) select p.u, p.v from p anti join g on g.u = p.u and g.v = p.v order by draw limit 3000"
)
def ranked_non_edges(spark, sf):
    return sampling.ranked_non_edges(graphs.copurchase(spark, sf).cached(), 3000, 5)


@query(f"with {S.G2} select cast(row_number() over (order by {HASH.format(9)}, u, v) as int) step, u, v from g qualify step <= 100")
def random_edge_deletions(spark, sf):
    return sampling.random_deletions(graphs.copurchase(spark, sf), 100, 9)


@query()
def random_walk_deletions(spark, sf):
    return sampling.random_walk_deletions(graphs.handover(spark, sf).cached(), 40, 2, walkers=10)


@query(
    f"with {ST1}, {S.DELETE}, {MM}, {REL}, c as (select u, v, {SECTOR} direction from rel), reps as (select c.*, cast(r as int) repeat, ({HASH.format(4)} * 31 + r * 104729 + direction * 1299709) % 1000003 h from c, (values (0), (1), (2)) t(r)), "
    "k as (select *, row_number() over (partition by direction, repeat order by h, u, v) i, count(*) over (partition by direction, repeat) n from reps) "
    "select direction, repeat, ratio, u, v from k, (values (0.1::double), (0.3::double)) q(ratio) where i <= ceil(round(ratio * n, 9))"
)
def nested_budget_pools(spark, sf):
    rows = _relatives(graphs.handover(spark, sf).cached())
    pools = rows.select(direction_class(F.col("rel_m2"), F.col("rel_m3"), 8).alias("direction"), "u", "v")
    return sampling.nested_pools(pools, [0.1, 0.3], 3, 4)


def _leverage(spark, sf) -> DataFrame:
    g = graphs.handover(spark, sf).cached()
    return spectral.probabilities(spectral.resistances(g.edges, spectral.components(g)))


@query(
    lambda: f"{_er_sql(0)}, pb as (select u, v, r / sum(r) over () prob, (u * 73856093 + v * 19349663) % 1000003 % 1024 b from er), "
    "ac as (select *, sum(prob) over (order by b, u, v rows unbounded preceding) hi from pb), sp as (select *, hi - prob lo from ac), "
    f"dr as (select {S.uniform(6, 'range')} * (select max(hi) from sp) x from range(500)) "
    f"select u, v, {R('count(*) / (500 * any_value(prob))', 'weight', 7)}, count(*) as count from dr join sp on x > lo and x <= hi group by u, v"
)
def sparsifier_with_replacement(spark, sf):
    return rounded(sampling.weighted_with_replacement(_leverage(spark, sf), 500, 6), 7)


@query(lambda: f"{_er_sql(0)}, pb as (select u, v, r / sum(r) over () prob from er) select u, v, {R('prob', 'prob', 9)} from pb order by -ln({S.uniform(6, 'u', 'v')}) / (prob + 1e-15), u, v limit 400")
def sparsifier_without_replacement(spark, sf):
    return rounded(sampling.weighted_without_replacement(_leverage(spark, sf), 400, 6).select("u", "v", "prob"), 9)


@query(
    f"with {ST2}, {S.walkers(20, 6, 3, S.drawn(3, 'id'))}, seen as ({' union '.join(f'select now id from st{k}' for k in range(7))}) "
    "select g.u, g.v from g where u in (select id from seen) and v in (select id from seen)"
)
def walk_subgraph(spark, sf):
    return sampling.walk_subgraph(graphs.copurchase(spark, sf).cached(), 20, 6, 3)


@query(
    f"with {S.G2}, e as (select count(*) c from g), f as (select {S.drawn(8, 'i', '1')} % cast(n as bigint) a, {S.drawn(8, 'i', '2')} % cast(n as bigint) b from (select unnest(range(cast(floor(0.1::double * c) as bigint))) i from e), nn) "
    f"select u, v from g where {S.uniform(8, 'u', 'v')} >= 0.2 union select least(a, b), greatest(a, b) from f where a <> b"
)
def perturbed_edges(spark, sf):
    g = graphs.copurchase(spark, sf).cached()
    return sampling.perturbed(g, 0.1, 0.2, 8, g.edges.count())


@query(
    f"with {S.G2}, {S.IDS}, k as (select id, row_number() over (order by (id * 73856093 + id * 19349663 + 2 * 83492791) % 1000003, id) - 1 r, n from ids, nn) "
    "select id, case when r < floor(n * 0.1) then 'train' when r < floor(n * 0.1) + floor(n * 0.8) then 'test' else 'valid' end part from k"
)
def node_split(spark, sf):
    return sampling.split_nodes(graphs.copurchase(spark, sf), 2)


# -- resistance and spectra ------------------------------------------------------------------------


@query(f"with {ST1} select u i, v j, {R('-1.0', 'w')} from g union all select v, u, {R('-1.0')} from g union all select id, id, {R('d')} from deg")
def laplacian_coo(spark, sf):
    return rounded(spectral.laplacian(graphs.handover(spark, sf).edges))


@query(f"with {ST1} select src i, dst j, {R('-1.0 / sqrt(p.d * q.d)', 'w')} from arcs join deg p on p.id = src join deg q on q.id = dst union all select id, id, {R('1.0')} from deg")
def normalized_laplacian(spark, sf):
    return rounded(spectral.laplacian(graphs.handover(spark, sf).edges, normalized=True))


@query(
    f"with recursive {S.G1}, {S.IDS}, arcs as (select u src, v dst from g union all select v, u from g), reach(id, r) as (select id, id from ids union select dst, r from reach join arcs on src = reach.id), "
    "c as (select id, min(r) r from reach group by id) select round(cast((select count(*) from ids) - (select count(distinct r) from c) as double), 6) + 0.0 as leverage"
)
def er_trace_identity(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return spectral.resistances(g.edges, spectral.components(g)).agg(tidy(F.sum("leverage"), 6).alias("leverage"))


def _er_sql(digits: int, prob: bool = True) -> str:
    """Resistances of a connected graph: a^T Z a, Z the sum of M^t for t < 64 by doubling, M the normalized adjacency less its eigenvalue 1."""
    ctes = [ST1, S.WALK, "top as (select id, sqrt(d / (select sum(d) from deg)) x from deg)"]
    ctes.append("m0 as materialized (select a.id i, b.id j, coalesce(s.w, 0.0) - a.x * b.x w from top a join top b on true left join s1 s on s.i = a.id and s.j = b.id)")
    ctes.append("z0 as (select id i, id j, 1.0::double w from deg)")
    for k in range(6):
        ctes.append(f"z{k + 1} as materialized (select i, j, sum(w) w from (select i, j, w from z{k} union all select x.i, y.j, x.w * y.w from z{k} x join m{k} y on x.j = y.i) group by 1, 2)")
        ctes.append(f"m{k + 1} as materialized (select x.i, y.j, sum(x.w * y.w) w from m{k} x join m{k} y on x.j = y.i group by 1, 2)")
    ctes.append(
        "er as (select u, v, a.w / p.d + b.w / q.d - 2 * c.w / sqrt(p.d * q.d) r from g join deg p on p.id = u join deg q on q.id = v "
        "join z6 a on a.i = u and a.j = u join z6 b on b.i = v and b.j = v join z6 c on c.i = u and c.j = v)"
    )
    if digits == 0:
        return f"with {', '.join(ctes)}"
    share = f", {R('r / sum(r) over ()', 'prob', digits)}" if prob else ""
    return f"with {', '.join(ctes)} select u, v, 1.0::double w, {R('r', 'resistance', digits)}, {R('r', 'leverage', digits)}{share} from er"


@query(_er_sql(9))
def effective_resistances(spark, sf):
    return rounded(_leverage(spark, sf), 9)


@query(_er_sql(7, False))
def solver_resistances(spark, sf):
    """The same by conjugate gradients on the edge table, as for components of any size."""
    g = graphs.handover(spark, sf).cached()
    return rounded(spectral.resistances(g.edges, spectral.components(g), dense_up_to=0), 7)


@query(f"with {S.G4} select u, v, 1.0::double w, 1.0::double resistance, 1.0::double leverage from g")
def star_resistances(spark, sf):
    """In a forest every edge is the only way between its ends."""
    g = graphs.stars(spark, sf).cached()
    return rounded(spectral.resistances(g.edges, spectral.components(g)), 6)


@query(_er_sql(9))
def normalized_resistances(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(spectral.probabilities(spectral.resistances(g.edges, spectral.components(g), normalized=True)), 9)


@query()
def approximate_resistances(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return spectral.resistances(g.edges, spectral.components(g), approximate=True, epsilon=0.3, seed=4)


def _spectrum(spark, sf, skip: int = 0) -> DataFrame:
    g = graphs.handover(spark, sf)
    edges = g.edges.filter(integer_hash(F.col("u"), F.col("v"), 1) >= skip)
    return spectral.whole_spectrum(Graph(edges, g.n))


@query(f"with {ST1}, {S.walks(2)} select cast(0 as bigint) graph_id, {R(S.moment(2), 'm2')}, {R(S.moment(3), 'm3')}, {R(S.moment(4), 'm4')}")
def spectrum_moments(spark, sf):
    g = graphs.handover(spark, sf)
    if g.n > spectral.DENSE_SPECTRUM:
        return rounded(spectral.spectrum_traces(g))
    return rounded(_spectrum(spark, sf).select("graph_id", "m2", "m3", "m4"))


@query(
    f"with {S.G4}, c as (select count(distinct u) n from g) "
    "select cast(range as int) pos, case when range < n then -1.0 else 0.0 end::double low, case when 3 - range <= n then 1.0 else 0.0 end::double high from range(3), c"
)
def spectrum_ends(spark, sf):
    """Each star of nations and customers has the eigenvalues -1 and 1; all others are 0."""
    rows = spectral.spectrum_ends(graphs.stars(spark, sf).cached(), 3)
    ends = rows.select(F.posexplode(F.arrays_zip("smallest", "largest")).alias("pos", "e"))
    return rounded(ends.select("pos", F.col("e.smallest").alias("low"), F.col("e.largest").alias("high")), 7)


@query()
def spectrum_ends_handover(spark, sf):
    return spectral.spectrum_ends(graphs.handover(spark, sf).cached(), 6)


@query()
def spectrum_rmse(spark, sf):
    return spectral.spectrum_rmse(_spectrum(spark, sf), _spectrum(spark, sf, 100_000))


def _factorial_sum(top: int) -> str:
    """Mean of exp(eigenvalue) by its series; the terms left out are below 2 / (top + 1)!."""
    return " + ".join(f"({S.moment(k)}) / {math.factorial(k)}.0" for k in range(2, top + 1))


@query(f"with {S.stats('trade')}, {S.walks(9)} select {R('1.0 + ' + _factorial_sum(18), 'value', 10)}")
def estrada_index(spark, sf):
    return rounded(spectral.estrada_index(graphs.trade(spark, sf)), 10)


@query(f"with {ST1}, {S.walks(4)} select {R('1.0 + ' + _factorial_sum(8), 'value', 5)}")
def estrada_by_series(spark, sf):
    return rounded(spectral.estrada_series(graphs.handover(spark, sf).cached(), 1e-5), 5)


@query(
    f"with {ST1}, {MM}, cs as (select id, sum(1.0 / sqrt(dx * dy)) s from corner group by id) select 'average_neighbour_inverse_degree' metric, {R('(select sum(w / d) from ns where d > 0) / n', 'value')} from nn "
    f"union all select 'weighted_clustering', {R(f'avg({CLUSTER})')} from ns left join cs on cs.id = ns.id union all select 'm2', {R('m2')} from mm union all select 'm3', {R('m3')} from mm"
)
def property_snapshot(spark, sf):
    return rounded(spectral.property_snapshot(graphs.handover(spark, sf).cached()))


# -- fingerprints ----------------------------------------------------------------------------------

PROFILE = f"pr as (select u, v, d2, d3, d2 / abs(m2) a, d3 / abs(m3) b from dels, mm), pa as (select *, sqrt(a * a + b * b) l, case when sqrt(a * a + b * b) > 1e-15 then (degrees(atan2(b, a)) + 360.0) % 360.0 end t from pr)"


@query(f"with {ST1}, {S.DELETE}, {MM}, {PROFILE} select u, v, {R('l', 'length', 9)}, {R('t', 'angle_deg', 6)} from pa")
def fingerprint_profile(spark, sf):
    rows = fingerprint.profile(graphs.handover(spark, sf).cached())
    return rows.select("u", "v", tidy(F.col("length"), 9).alias("length"), tidy(F.col("angle_deg"), 6).alias("angle_deg"))


@query(
    f"with {ST1}, {S.DELETE}, {MM}, {PROFILE}, gr as (select cast(range as int) bin, range * 5.0::double deg from range(72)), kd as (select bin, sum(exp(-0.5 * power(abs(deg - t - 360.0 * floor((deg - t + 180.0) / 360.0)) / 3.0, 2))) s from gr, pa where t is not null group by bin) "
    f"select gr.bin, gr.deg, {R('s / (select sum(s) from kd)', 'prob', 10)}, {R('sqrt(2.0 * s / (select sum(s) from kd) / radians(5.0))', 'radius', 9)} from gr join kd using (bin)"
)
def fingerprint_grid(spark, sf):
    rows = fingerprint.area_radius(fingerprint.density(fingerprint.profile(graphs.handover(spark, sf).cached()), 5.0, 3.0), 5.0)
    return rows.select("bin", "deg", tidy(F.col("prob"), 10).alias("prob"), tidy(F.col("radius"), 9).alias("radius"))


@query(
    f"with {ST1}, {S.DELETE}, {MM}, {PROFILE}, gr as (select cast(range as int) bin, range * 10.0::double deg from range(36)), kd as (select u % 4 gid, bin, sum(exp(-0.5 * power(abs(deg - t - 360.0 * floor((deg - t + 180.0) / 360.0)) / 20.0, 2))) s from gr, pa where t is not null group by 1, 2), "
    "p as (select gid, bin, s / sum(s) over (partition by gid) prob from kd) select bin, round(avg(prob), 9) + 0.0 as mean, round(quantile_cont(prob, 0.25), 9) + 0.0 as low, round(quantile_cont(prob, 0.75), 9) + 0.0 as high from p group by bin"
)
def iqr_band(spark, sf):
    rows = fingerprint.profile(graphs.handover(spark, sf).cached()).withColumn("gid", F.col("u") % 4)
    return rounded(fingerprint.band(fingerprint.density(rows, 10.0, 20.0, ("gid",))), 9)


# -- reporting -------------------------------------------------------------------------------------

RUNS = (
    "runs as (select cast(l_linenumber as int) repeat, l_returnflag as method, l_linestatus as dataset, cast(l_orderkey % 10 as int) seed, l_orderkey as run, cast(l_quantity as double) score, cast(l_discount as double) cost from lineitem)"
)


def _runs(spark, sf) -> DataFrame:
    return graphs.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("repeat"),
        F.col("l_returnflag").alias("method"),
        F.col("l_linestatus").alias("dataset"),
        F.pmod("l_orderkey", F.lit(10)).cast("int").alias("seed"),
        F.col("l_orderkey").alias("run"),
        F.col("l_quantity").cast("double").alias("score"),
        F.col("l_discount").cast("double").alias("cost"),
    )


@query(f"with {RUNS} select dataset, method, count(*) as count, {R('avg(score)', 'score_mean', 9)}, {R('stddev_pop(score)', 'score_std', 9)}, {R('avg(cost)', 'cost_mean', 9)}, {R('stddev_pop(cost)', 'cost_std', 9)} from runs group by 1, 2")
def summary_by_config(spark, sf):
    return rounded(reporting.summarize(_runs(spark, sf), ("dataset", "method"), ("score", "cost")), 9)


@query(f"with {RUNS} select method, repeat, count(*) as count, {R('avg(score)', 'mean', 9)}, {R('stddev_pop(score)', 'std', 9)}, {R('1.96 * stddev_pop(score) / sqrt(count(*))', 'ci95', 9)} from runs group by 1, 2")
def group_interval(spark, sf):
    return rounded(reporting.interval(_runs(spark, sf), ["method", "repeat"], "score"), 9)


@query(
    f"with {RUNS}, one as (select repeat, seed, dataset, avg(score) score, max(run) run from runs where method = 'A' group by 1, 2, 3), ctl as (select repeat, seed, arg_max(score, o) control from (select repeat, seed, score, run * 1000 + score o from runs where method = 'R') group by 1, 2) "
    f"select repeat, seed, dataset, {R('score', 'score', 9)}, {R('control', 'control', 9)}, {R('score - control', 'difference', 9)} from one join ctl using (repeat, seed)"
)
def paired_vs_random(spark, sf):
    runs = _runs(spark, sf)
    one = runs.filter("method = 'A'").groupBy("repeat", "seed", "dataset").agg(F.avg("score").alias("score"))
    control = runs.filter("method = 'R'").withColumn("o", F.col("run") * 1000 + F.col("score"))
    return rounded(reporting.paired(one, control, ["repeat", "seed"], "score", "o").select("repeat", "seed", "dataset", "score", "control", "difference"), 9)


@query(
    f"with {RUNS}, p as (select seed, avg(score) mean, stddev_pop(score) std from runs group by seed) select seed, {R('mean', 'mean', 9)}, {R('std', 'std', 9)}, seed = (select seed from p order by mean desc, seed limit 1) is_best from p"
)
def landscape_best(spark, sf):
    return rounded(reporting.best_point(_runs(spark, sf), "seed", "score"), 9)


@query(f"with {RUNS} select {R('score', 'm2', 12)}, {R('cost', 'm3', 12)}, {R('avg(repeat)', 'mean', 9)} from runs group by round(score, 12), round(cost, 12), 1, 2")
def coordinate_means(spark, sf):
    rows = _runs(spark, sf).select(F.col("score").alias("m2"), F.col("cost").alias("m3"), F.col("repeat").cast("double").alias("acc"))
    out = reporting.coordinate_mean(rows, "acc")
    return out.select(tidy(F.col("m2")).alias("m2"), tidy(F.col("m3")).alias("m3"), tidy(F.col("mean"), 9).alias("mean"))


@query(f"with {RUNS} select distinct run, repeat from runs")
def merged_shards(spark, sf):
    keys = _runs(spark, sf).select("run", "repeat").distinct()
    shards = [keys.filter(F.pmod("run", F.lit(4)) == k) for k in range(4)]
    return reporting.merged_shards(shards, ["run", "repeat"], keys)


@query("select o_orderkey as row_index from orders where o_orderkey % 4 = 1 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def pending_jobs(spark, sf):
    jobs = graphs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"))
    done = graphs.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("row_index"))
    return reporting.pending(jobs, done, ["row_index"], 1, 4)


EDIT_RUNS = "e as (select l_orderkey run_id, count(*) filter (where l_linenumber % 2 = 0) added, count(*) filter (where l_linenumber % 2 = 1) deleted from lineitem group by 1), f as (select *, abs(added - deleted) uneven from e)"


@query(f"with {EDIT_RUNS} select " + ", ".join(f"{R(f'{fn}({c})', f'{c}_{n}', 9)}" for c in ("added", "deleted", "uneven") for n, fn in (("mean", "avg"), ("std", "stddev_pop"))) + " from f")
def edit_history_stats(spark, sf):
    rows = graphs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") % 2 == 0, "add").otherwise("delete").alias("op"))
    return rounded(reporting.edit_stats(rows), 9)


@query(
    "with e as (select distinct l_suppkey % 5 graph_id, least(l_partkey, l_orderkey % 200) a, greatest(l_partkey, l_orderkey % 200) b from lineitem where l_partkey <> l_orderkey % 200), "
    "i as (select distinct graph_id, id from (select graph_id, a id from e union all select graph_id, b from e)), k as (select graph_id, id, row_number() over (partition by graph_id order by id) - 1 x from i) "
    "select cast(e.graph_id as bigint) graph_id, cast(p.x as bigint) u, cast(q.x as bigint) v from e join k p on p.graph_id = e.graph_id and p.id = e.a join k q on q.graph_id = e.graph_id and q.id = e.b"
)
def graph_collection(spark, sf):
    rows = graphs.table(spark, sf, "lineitem").select(F.pmod("l_suppkey", F.lit(5)).cast("long").alias("graph_id"), F.col("l_partkey").cast("long").alias("u"), F.pmod("l_orderkey", F.lit(200)).cast("long").alias("v"))
    return files.read_collection(rows)[0]


# -- graph weights and diffusion -------------------------------------------------------------------


def _pagerank_sql(rounds: int) -> str:
    ctes = [ST1, "x0 as (select id, 1.0::double x from ids)"]
    for k in range(1, rounds + 1):
        ctes.append(f"x{k} as (select p.id, 0.15 * p.x + 0.85 * coalesce(f.f, 0.0) x from x{k - 1} p left join (select dst id, sum(y.x / d) f from arcs join x{k - 1} y on y.id = src join deg on deg.id = src group by dst) f on f.id = p.id)")
    return f"with {', '.join(ctes)} select id, {R('x', 'x')} from x{rounds}"


@query(_pagerank_sql(10))
def pagerank_weights(spark, sf):
    return rounded(spectral.pagerank(graphs.handover(spark, sf).cached()))


@query(f"with {ST2}, w as (select src, dst, ln(d) s from arcs join deg on id = dst) select src, dst, {R('coalesce((max(s) over () - s) / nullif(max(s) over () - avg(s) over (), 0), 0.0)', 'w', 9)} from w")
def degree_weights(spark, sf):
    g = graphs.copurchase(spark, sf).cached()
    return rounded(spectral.arc_weights(g, stats.degrees(g), "d"), 9)


def _eigenvector_sql() -> str:
    """Row sums of (A + I)^128 by squaring, to unit length; entries are scaled at each square."""
    ctes = [ST1, "e0 as (select src i, dst j, 1.0::double w from arcs union all select id, id, 1.0 from ids)"]
    for k in range(7):
        ctes.append(f"f{k} as materialized (select x.i, y.j, sum(x.w * y.w) w from e{k} x join e{k} y on x.j = y.i group by 1, 2), e{k + 1} as materialized (select i, j, w / (select max(w) from f{k}) w from f{k})")
    return f"with {', '.join(ctes)}, es as (select i id, sum(w) x from e7 group by i) select id, {R('x / (select sqrt(sum(x * x)) from es)', 'x', 7)} from es"


@query(_eigenvector_sql())
def eigenvector_centrality(spark, sf):
    return rounded(spectral.eigenvector_centrality(graphs.handover(spark, sf).cached()), 7)


@query(
    f"with {ST1}, fx as (select id, f feature, ((id * 7 + f * 3) % 5 + 1)::double x from ids, (select range f from range(6))), "
    "s as (select feature, ln(sum(x * d)) s from fx join deg using (id) group by feature) select feature, round(coalesce((max(s) over () - s) / nullif(max(s) over () - avg(s) over (), 0), 0.0), 9) + 0.0 as w from s"
)
def feature_weights(spark, sf):
    g = graphs.handover(spark, sf).cached()
    rows = g.nodes().select("id", F.explode(F.array(*[F.lit(f).cast("long") for f in range(6)])).alias("feature"))
    rows = rows.withColumn("x", (F.pmod(F.col("id") * 7 + F.col("feature") * 3, F.lit(5)) + 1).cast("double"))
    return rounded(spectral.feature_weights(rows, stats.degrees(g), "d"), 9)


LOOPED = "lw as (select i, j, 1.0 / sqrt((p.d + 1) * (q.d + 1)) w from (select src i, dst j from arcs union all select id, id from ids) a join ns p on p.id = i join ns q on q.id = j)"


@query(f"with {ST1}, {LOOPED} select i, j, {R('w', 'w')} from lw")
def looped_normalization(spark, sf):
    return rounded(spectral.looped_normalized(graphs.handover(spark, sf)))


@query(
    f"with {ST1}, {LOOPED}, l2 as (select x.i, y.j, sum(x.w * y.w) w from lw x join lw y on x.j = y.i group by 1, 2), l3 as (select x.i, y.j, sum(x.w * y.w) w from l2 x join lw y on x.j = y.i group by 1, 2), "
    f"t as (select id i, id j, 1.0 / 3 w from ids union all select i, j, w / 3 from lw union all select i, j, w / 3 from l2 union all select i, j, w / 3 from l3 union all select i, j, 0.05 * w from lw) "
    f"select i, j, {R('sum(w)', 'w', 10)} from t group by i, j having sum(w) >= 1e-4"
)
def markov_diffusion(spark, sf):
    return rounded(spectral.markov_diffusion(graphs.handover(spark, sf).cached()), 10)


@query(
    f"with {ST1}, lo as (select src i, dst j from arcs union all select id, id from ids) select p.id i, q.id j, {R('exp(5.0 * (case when lo.i is null then 0.0 else 1.0 / (q.d + 1) end - 1.0))', 'w')} "
    "from ns p cross join ns q left join lo on lo.i = p.id and lo.j = q.id"
)
def heat_kernel(spark, sf):
    return rounded(spectral.heat_kernel(graphs.handover(spark, sf)))


def _ppr_sql() -> str:
    """Table ppr(i, j, w): 0.2 times the sum of (0.8 T)^t for t < 128, by doubling; 0.8^128 is below 1e-12."""
    ctes = [ST1, LOOPED, "b0 as (select i, j, 0.8 * w w from lw)", "z0 as (select id i, id j, 1.0::double w from ids)"]
    for k in range(7):
        ctes.append(f"z{k + 1} as materialized (select i, j, sum(w) w from (select i, j, w from z{k} union all select x.i, y.j, x.w * y.w from z{k} x join b{k} y on x.j = y.i) group by 1, 2)")
        ctes.append(f"b{k + 1} as materialized (select x.i, y.j, sum(x.w * y.w) w from b{k} x join b{k} y on x.j = y.i group by 1, 2)")
    return f"with {', '.join(ctes)}, ppr as (select i, j, 0.2 * w w from z7)"


@query(f"{_ppr_sql()}, pk as (select * from ppr where w >= 1e-4) select i, j, {R('w / sum(w) over (partition by i)', 'w', 9)} from pk")
def ppr_diffusion(spark, sf):
    return rounded(spectral.ppr_diffusion(graphs.handover(spark, sf).cached()), 9)


@query(
    f"{_ppr_sql()}, ep as (select e from (values (1e-5::double), (1e-4::double), (1e-3::double), (1e-2::double)) t(e)), "
    "ch as (select e from ep order by abs((select count(*) from ppr where w >= e) / (select n from nn) - 20.0), e limit 1), kp as (select ppr.* from ppr, ch where w >= e), "
    f"lh as (select j, min(w) lo, max(w) hi from kp group by j) select i, kp.j, {R('coalesce((w - lo) / nullif(hi - lo, 0), 0.0)', 'w', 8)} from kp join lh on lh.j = kp.j"
)
def sparsified_diffusion(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(spectral.sparsified_ppr(g, 20.0), 8)


@query(
    f"with recursive {ST1}, nb as (select src, dst from arcs union all select id, id from ids), dd as (select id, d + 1.0 d from ns), "
    "st(t, i, j, r) as (select 0, id, id, 1.0::double from ids union all select t, i, j, sum(r) from ("
    "select t + 1 t, i, j, r from st join dd on id = j where r <= 1e-5 * d and exists (select 1 from st s join dd e on e.id = s.j where s.r > 1e-5 * e.d) "
    "union all select t + 1, i, dst, 0.8 * r / d from st join dd on id = j join nb on src = j where r > 1e-5 * d) group by t, i, j) "
    f"select i, j, {R('sum(0.2 * r) * sqrt(any_value(p.d) / any_value(q.d))', 'w', 9)} from st join dd q on q.id = j join dd p on p.id = i where r > 1e-5 * q.d group by i, j"
)
def ppr_push(spark, sf):
    """Forward push from every node until no residual is above 1e-5 times its degree."""
    return rounded(spectral.ppr_push(graphs.handover(spark, sf).cached(), epsilon=1e-5), 9)


@query("select cast(l_suppkey as bigint) src, cast(l_partkey as bigint) dst, round(sum(l_quantity), 6) + 0.0 as w from lineitem group by 1, 2")
def coalesced_arcs(spark, sf):
    rows = graphs.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("w"))
    return rounded(spectral.coalesce_arcs(rows), 6)


# -- experiments -----------------------------------------------------------------------------------


@query()
def spectral_greedy_deletion(spark, sf):
    g = graphs.trade(spark, sf)
    return spectral.spectral_greedy(g, 3)


@query(
    f"with {S.G1}, {S.IDS}, {EDITS}, {AFTER}, {_after('g')}, {_after('g2')} select 'm2' metric, {R('abs(a.m2 - b.m2)', 'distance')} from m_g a, m_g2 b union all select 'm3', {R('abs(a.m3 - b.m3)')} from m_g a, m_g2 b"
)
def property_distances(spark, sf):
    g = graphs.handover(spark, sf).cached()
    return rounded(spectral.property_distances(g, deltas.apply_edits(g, *_edits(g)), ("m2", "m3")))


@query(f"with {S.G2}, {S.IDS}, k as (select id from ids where {S.uniform(5, 'id')} >= 0.2) select u, v from g where u in (select id from k) and v in (select id from k)")
def dropped_nodes(spark, sf):
    return sampling.drop_nodes(graphs.copurchase(spark, sf), 0.2, 5)


@query(
    f"with {ST2}, l as (select src, dst, ln(d) s from arcs join deg on id = dst), w as (select src, dst, coalesce((max(s) over () - s) / nullif(max(s) over () - avg(s) over (), 0), 0.0) w from l) "
    f"select src, dst, {R('w', 'w', 9)} from w where {S.uniform(5, 'src', 'dst')} >= least(0.7, w / (select avg(w) from w) * 0.3)"
)
def dropped_arcs(spark, sf):
    g = graphs.copurchase(spark, sf).cached()
    return rounded(sampling.drop_arcs_by_weight(spectral.arc_weights(g, stats.degrees(g), "d"), 0.3, 5), 9)


@query()
def property_preservation(spark, sf):
    from ..operators import experiments

    return experiments.preservation(graphs.handover(spark, sf).cached(), most=0.05, step=0.05, metrics=("m2", "m3"))


@query()
def linear_probe(spark, sf):
    from ..operators import experiments

    rows = graphs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")
    return experiments.linear_probe(rows)


@query(f"with {S.G2}, {S.IDS}, k as (select id from ids order by {S.drawn(3, 'id')}, id limit 500) select u, v from g where u in (select id from k) and v in (select id from k)")
def random_node_subgraph(spark, sf):
    g = graphs.copurchase(spark, sf)
    return graph.induced(g.edges, sampling.random_nodes(g, 500, 3))
