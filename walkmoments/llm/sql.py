"""DuckDB SQL for the training-data queries that SQL can express. Whole tables, as the queries read."""

from __future__ import annotations

from . import chat, secrets

NEIGHBOURS = """with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda s, x: s + x) score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p qualify rank <= 20"""


def _escape(x: str, role: bool = False) -> str:
    out = f"replace({x}, '\\', '\\b')"
    for plain, code in ((f"'{chat.CLOSE}'", "\\e"), (f"'{chat.OPEN}'", "\\s"), *((("'>'", "\\g"), ("chr(10)", "\\n")) if role else ())):
        out = f"replace({out}, {plain}, '{code}')"
    return out


_MARKED = f"{len(chat.OPEN) + 2 + len(chat.CLOSE) + 1} + length({_escape('role', True)}) + length({_escape('txt')})"
CHAT = f"""with r as (select conv_id, turn, role, text from conversations
  union all select -7, range, case range when 0 then 'user' else 'assistant' end, '\\### Assistant: </turn> ok' from range(2)),
t as (select conv_id, coalesce(turn, -4611686018427387904) tn, coalesce(role, '') role, coalesce(text, '') txt from r),
m as (select *, {_MARKED} marked, cast(ceil(({_MARKED}) / 4.0) as bigint) tokens from t),
c as (select conv_id, sum(tokens) total, {chat.BUDGET} - coalesce(first(tokens order by tn, txt) filter (where role = 'system'), 0) room from m group by conv_id),
h as (select *, greatest(cast(floor(greatest(room - {chat.HISTORY}, floor(room / 2.0)) / 2.0) as bigint), 1) half from c),
o as (select m.*, room, half, total, row_number() over w rn, coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) before
  from m join h on h.conv_id is not distinct from m.conv_id window w as (partition by m.conv_id order by tn, role, txt)),
b as (select *, total > {chat.BUDGET} and tokens > half big, case when total <= {chat.BUDGET} then 0 else cast(floor(before / half) as bigint) end span from o),
s as (select conv_id, span, big, min(before) start, sum(tokens) own, any_value(room) room from b group by 1, 2, 3),
n as (select *, row_number() over w - 1 win, lead(least({chat.HISTORY}, room - own)) over w takes from s window w as (partition by conv_id order by span, big)),
p as (select b.*, n.win, n.start, n.own, n.takes from b join n on n.conv_id is not distinct from b.conv_id and n.span = b.span and n.big = b.big),
f as (select conv_id, min(before) first_at, arg_min(win, before) win, arg_min(marked, before) marked from p where role = 'system' group by conv_id)
select p.conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by rn)) turns_sha256,
  length(coalesce(string_agg(txt, '' order by rn) filter (where role = 'assistant'), '')) loss_chars,
  sha256(coalesce(string_agg(txt, '' order by rn) filter (where role = 'assistant'), '')) loss_sha256,
  cast(sum(p.marked) + coalesce(sum(p.marked) filter (where start + own - before <= takes and before is distinct from f.first_at), 0)
    + coalesce(any_value(f.marked) * (max(p.win) - any_value(f.win)), 0) as bigint) formatted_chars, max(p.win) + 1 n_windows
from p left join f on f.conv_id is not distinct from p.conv_id group by p.conv_id"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: LOOSE without look-around: a maximal run, then held to have lower case, upper case and a digit.
_RUN = r"[A-Za-z0-9+/_-]{20,}"
_KINDS = " union all ".join(
    f"select rid, '{kind}' kind, {order} ord, {least} least, regexp_extract_all(t, {_q(p)}) m, regexp_extract_all(t, {_q(p)}, {group}) c, string_split_regex(t, {_q(p)}) g from hit"
    for order, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items())
    for p in [_RUN if kind == "loose" else pattern]
)
_S = secrets.SCOPE
SECRETS = f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
hit as (select * from d where regexp_matches(t, {_q(secrets.MARK)})),
k as ({_KINDS}),
u as (select *, unnest(range(1, len(m) + 1)) i from k),
b as (select rid, kind, ord, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) s, length(m[i]) l
  from u where length(c[i]) >= least and (kind <> 'loose' or (regexp_matches(m[i], '[a-z]') and regexp_matches(m[i], '[A-Z]') and regexp_matches(m[i], '[0-9]')))),
a as (select *, s + l z, kind in ('assign', 'access', 'hex') base from b),
c as (select * from a x where base or not exists (select 1 from a y where y.rid = x.rid and y.base and y.s < x.z and y.z > x.s)),
f as (select *, exists (select 1 from c y where y.rid = x.rid and y.kind in ('access', 'ident') and abs(y.s - x.s) <= {_S}) ident,
  exists (select 1 from c y where y.rid = x.rid and y.kind in ('assign', 'hex', 'loose') and abs(y.s - x.s) <= {_S}) secret from c x),
w as (select *, kind || ':' || s || ':' || z said from f where base or (kind = 'loose' and ident) or (kind = 'ident' and secret) or (kind = 'endpoint' and ident and secret))
select d.doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
  sha256(coalesce(string_agg(said, ',' order by s, ord) filter (where base), '')) base_sha256, coalesce(string_agg(said, ',' order by s, ord), '') spans,
  count(*) filter (where not base) n_linked from d left join w on w.rid = d.rid group by d.rid, d.doc_id"""


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""with d as (select doc_id, row_number() over () rid, {_TERMS.format("coalesce(text, '')")} t from documents),
g as (select count(*) n_docs, cast(sum(len(t)) as bigint) n_terms from d where len(t) > 0),
p as (select rid, term, count(*) tf from (select rid, unnest(t) term from d) group by all),
f as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) w from p, g group by term),
q as (select item_id, unnest({_TERMS.format("text")}) term from (select item_id, min(coalesce(text, '')) as text from benchmark where item_id is not null group by 1)),
a as (select item_id, term, count(*) n from q group by all),
m as (select rid, doc_id, 75 + (25 * len(t) * n_docs) // n_terms m from d, g where len(t) > 0),
s as (select item_id, rid, any_value(doc_id) doc_id, cast(sum(a.n * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) score
  from a join p using (term) join f using (term) join m using (rid) group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0 qualify rank <= 20"""

NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as y,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) c from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, r.vec_id other_id, a.y = r.y alike, cast(list_inner_product(a.c, r.c) as bigint) score
  from v a join v r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
p as (select anchor_id, other_id positive_id, score positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.other_id) as int) as rank,
  s.other_id negative_id, positive_score, s.score negative_score
from p join s using (anchor_id) where not s.alike and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score qualify rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_curve_neighbours": NEIGHBOURS, "op2_chat_windows": CHAT, "op4_secret_scan": SECRETS, "op12_wand_search": SEARCH, "op13_hard_negatives": NEGATIVES}
