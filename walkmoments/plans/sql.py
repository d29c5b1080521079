"""SQL building blocks: the same graphs and statistics as common table expressions, for DuckDB."""

from __future__ import annotations

G1 = """g as (select distinct cast(least(a,b) as bigint) u, cast(greatest(a,b) as bigint) v from (
  select user_id a, lead(user_id) over (order by ts, event_id) b from events where event_type = 'purchase') t
  where b is not null and a <> b),
nn as (select cast(max(user_id) + 1 as double) n from events)"""
G2 = """g as (select distinct cast(a.l_partkey as bigint) u, cast(b.l_partkey as bigint) v from lineitem a
  join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey
  join orders o on o.o_orderkey = a.l_orderkey where o.o_orderpriority = '1-URGENT'),
nn as (select cast(count(*) as double) n from part)"""
G3 = """g as (select distinct cast(l_suppkey as bigint) u, cast(l_partkey + (select count(*) from supplier) as bigint) v from lineitem),
nn as (select cast((select count(*) from supplier) + (select count(*) from part) as double) n)"""
G4 = """g as (select cast(c_nationkey as bigint) u, cast(c_custkey + 25 as bigint) v from customer),
nn as (select cast(count(*) + 25 as double) n from customer)"""
G5 = """g as (select distinct cast(least(c_nationkey, s_nationkey) as bigint) u, cast(greatest(c_nationkey, s_nationkey) as bigint) v
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey), nn as (select 25.0::double n)"""
GRAPHS = {"handover": G1, "copurchase": G2, "supply": G3, "stars": G4, "trade": G5}


#: Every node id.
IDS = "ids as (select unnest(range(cast(n as bigint))) id from nn)"

DEGREE = """arcs as (select u src, v dst from g union all select v, u from g),
deg as (select src id, cast(count(*) as double) d from arcs group by src)"""
MASS = """wt as (select src id, sum(1.0 / d) w from arcs join deg on dst = id group by src),
tri as (select x.u a, x.v b, y.v c, p.d da, q.d db, r.d dc from g x join g y on x.v = y.u join g z on z.u = x.u and z.v = y.v
  join deg p on p.id = x.u join deg q on q.id = x.v join deg r on r.id = y.v),
corner as (select a id, b x, c y, da d, db dx, dc dy from tri union all select b, a, c, db, da, dc from tri union all select c, a, b, dc, da, db from tri),
ht as (select id, sum(1.0 / (dx * dy)) h from corner group by id),
em as (select x u, y v, sum(1.0 / d) m from corner group by x, y)"""


def stats(graph: str) -> str:
    """g, nn, arcs, deg, wt, tri, corner, ht, em, ids, ns (id, d, w, h of every node)."""
    ns = """ns as (select i.id, coalesce(d, 0.0) d, coalesce(w, 0.0) w, coalesce(h, 0.0) h from ids i
  left join deg on deg.id = i.id left join wt on wt.id = i.id left join ht on ht.id = i.id)"""
    return f"{GRAPHS[graph]},\n{DEGREE},\n{MASS},\n{IDS},\n{ns}"


WALK = """s1 as (select src i, dst j, 1.0 / sqrt(p.d * q.d) w from arcs join deg p on p.id = src join deg q on q.id = dst)"""


def walks(top: int) -> str:
    out = [WALK]
    for k in range(2, top + 1):
        out.append(f"s{k} as (select x.i, y.j, sum(x.w * y.w) w from s{k - 1} x join s1 y on x.j = y.i group by x.i, y.j)")
    return ",\n".join(out)


def moment(k: int) -> str:
    """Scalar sub-select of m_k; needs deg, tri and the walks of order ceil(k / 2)."""
    if k == 1:
        return "0.0::double"
    if k == 2:
        return "(select sum(2.0 / (p.d * q.d)) from g join deg p on p.id = u join deg q on q.id = v) / (select n from nn)"
    if k == 3:
        return "coalesce((select sum(6.0 / (da * db * dc)) from tri), 0.0) / (select n from nn)"
    a, b = k - k // 2, k // 2
    return f"(select sum(x.w * y.w) from s{a} x join s{b} y on x.i = y.i and x.j = y.j) / (select n from nn)"


GAP = "(case when {0} > 1 then {0} * ({0} - 1.0) else 1.0 end)"
DELETE = f"""dels as (select g.u, g.v, du, dv, wu, wv, hu, hv, m,
  (2.0 / n) * ((wu - 1.0 / dv) / {GAP.format('du')} + (wv - 1.0 / du) / {GAP.format('dv')} - 1.0 / (du * dv)) d2,
  (6.0 / n) * ((hu - m / dv) / {GAP.format('du')} + (hv - m / du) / {GAP.format('dv')} - m / (du * dv)) d3
  from (select g.u, g.v, a.d du, b.d dv, a.w wu, b.w wv, a.h hu, b.h hv, coalesce(em.m, 0.0) m from g
    join ns a on a.id = g.u join ns b on b.id = g.v left join em on em.u = g.u and em.v = g.v) g, nn)"""
LOSS = "(case when {1} > 0 then {0} / ({1} * ({1} + 1.0)) else 0.0 end)"
ADD = f"""pairs as (select a.id u, b.id v from ids a join ids b on a.id < b.id anti join g on g.u = a.id and g.v = b.id),
pm as (select x.src u, y.src v, sum(1.0 / d) m from arcs x join arcs y on x.dst = y.dst and x.src < y.src join deg on deg.id = x.dst group by x.src, y.src),
adds as (select u, v, (2.0 / n) * (1.0 / ((du + 1.0) * (dv + 1.0)) - {LOSS.format('wu', 'du')} - {LOSS.format('wv', 'dv')}) d2,
  (6.0 / n) * (m / ((du + 1.0) * (dv + 1.0)) - {LOSS.format('hu', 'du')} - {LOSS.format('hv', 'dv')}) d3
  from (select p.u, p.v, a.d du, b.d dv, a.w wu, b.w wv, a.h hu, b.h hv, coalesce(pm.m, 0.0) m from pairs p
    join ns a on a.id = p.u join ns b on b.id = p.v left join pm on pm.u = p.u and pm.v = p.v) t, nn)"""


def r(x: str, name: str | None = None, digits: int = 12) -> str:
    return f"round({x}, {digits}) + 0.0" + (f" as {name}" if name else "")


def walk_deltas(source: str, top: int, adding: bool) -> str:
    """deltas as a table wd(u, v, p1..p<top>) over ``source`` (u, v); needs ns, nn and the walks up to ``top``."""
    cols = ["p.u", "p.v", "a.d du", "b.d dv", "1.0 uu0", "1.0 vv0", "0.0 uv0", "0.0 vu0"]
    joins = []
    for t in range(1, top + 1):
        cols += [
            f"coalesce(x{t}.w, 0.0) uu{t}",
            f"coalesce(y{t}.w, 0.0) vv{t}",
            f"coalesce(sqrt(a.d / nullif(b.d, 0.0)) * z{t}.w, 0.0) uv{t}",
            f"coalesce(sqrt(b.d / nullif(a.d, 0.0)) * z{t}.w, 0.0) vu{t}",
        ]
        joins += [
            f"left join s{t} x{t} on x{t}.i = p.u and x{t}.j = p.u",
            f"left join s{t} y{t} on y{t}.i = p.v and y{t}.j = p.v",
            f"left join s{t} z{t} on z{t}.i = p.u and z{t}.j = p.v",
        ]
    sv = f"sv as (select {', '.join(cols)} from {source} p join ns a on a.id = p.u join ns b on b.id = p.v {' '.join(joins)})"
    hs = []
    for t in range(top):
        if adding:
            parts = [f"(uv{t} - uu{t + 1}) / (du + 1)", f"(uu{t} - uv{t + 1}) / (dv + 1)", f"(vv{t} - vu{t + 1}) / (du + 1)", f"(vu{t} - vv{t + 1}) / (dv + 1)"]
        else:
            parts = [
                f"case when du > 1 then (uu{t + 1} - uv{t}) / (du - 1) else -uv{t} end",
                f"case when dv > 1 then (uv{t + 1} - uu{t}) / (dv - 1) else -uu{t} end",
                f"case when du > 1 then (vu{t + 1} - vv{t}) / (du - 1) else -vv{t} end",
                f"case when dv > 1 then (vv{t + 1} - vu{t}) / (dv - 1) else -vu{t} end",
            ]
        hs += [f"{x} h{t}_{k}" for k, x in enumerate(parts)]
    out = [sv, f"hs as (select u, v, {', '.join(hs)} from sv)"]
    ds = []
    for j in range(1, top + 1):
        text = f"-(h{j - 1}_0 + h{j - 1}_3)"
        for a in range(1, j):
            text += f" + h{a - 1}_0 * h{j - a - 1}_3 - h{a - 1}_1 * h{j - a - 1}_2"
        ds.append(f"{text} d{j}")
    out.append(f"ds as (select u, v, {', '.join(ds)} from hs)")
    last = "ds"
    for k in range(1, top + 1):
        text = f"-{k} * d{k}" + "".join(f" - d{j} * p{k - j}" for j in range(1, k))
        out.append(f"q{k} as (select *, {text} p{k} from {last})")
        last = f"q{k}"
    out.append(f"wd as (select {last}.*, n from {last}, nn)")
    return ",\n".join(out)


def drawn(seed: int, *cols: str) -> str:
    """The same number as functions.drawn."""
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(cols)})), 1, 15) as bigint)"


def uniform(seed: int, *cols: str) -> str:
    return f"((cast({drawn(seed, *cols)} as double) + 0.5) / 1152921504606846976::double)"


def walkers(count: int, steps: int, seed: int, first: str) -> str:
    """Table st0..: id, start, now of seeded walks; ``first`` is the start drawn for an id. Needs arcs, deg and nn."""
    out = ["place as (select src, dst, row_number() over (partition by src order by dst) - 1 spot from arcs)", f"st0 as (select id, {first} % cast(n as bigint) start, {first} % cast(n as bigint) now from (select range id from range({count})), nn)"]
    for k in range(1, steps + 1):
        out.append(f"st{k} as materialized (select s.id, start, p.dst now from st{k - 1} s join deg on deg.id = s.now join place p on p.src = s.now and p.spot = {drawn(seed, 's.id', str(k))} % cast(d as bigint))")
    return ", ".join(out)
