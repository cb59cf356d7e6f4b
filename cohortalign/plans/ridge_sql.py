"""Linear systems and ridges as SQL: normal equations from joins, solved by elimination in a recursive query.

Each function returns common table expressions; a statement that uses them begins ``with recursive``.
"""


def eliminated(name: str, augmented: str) -> str:
    """``name``(key, a): the rows [A | B] of ``augmented``(key, a double[][], n) reduced to [1 | X], without pivoting, as A is positive definite."""
    return f"""{name}_gj as (
  select key, 1::bigint as k, n, a from {augmented}
  union all
  select key, k + 1, n, list_transform(a, lambda r, i: list_transform(r, lambda x, j:
    case when i = k then x / a[k][k] else x - r[k] * a[k][j] / a[k][k] end)) from {name}_gj where k <= n),
{name} as (select key, a from {name}_gj where k = n + 1)"""


def moments(name: str, rows: str, scale: bool, scaling: str | None = None) -> str:
    """``name``_x(key, rid, f, v) and ``name``_z(key, rid, t, v): centred features, scaled where asked, and centred targets of
    ``rows``(key, rid, x, z); ``name``_s(key, f, m, sd) and ``name``_b(key, t, m). ``scaling``: another's _s to use instead of the own."""
    own = f"select key, f, avg(v) as m, {'greatest(stddev_pop(v), 1e-8)' if scale else '1.0::double'} as sd from {name}_xl group by 1, 2"
    return f"""{name}_xl as (select key, rid, unnest(range(len(x))) as f, unnest(x)::double as v from {rows}),
{name}_zl as (select key, rid, unnest(range(len(z))) as t, unnest(z)::double as v from {rows}),
{name}_s as ({own if scaling is None else f'select * from {scaling}'}),
{name}_b as (select key, t, avg(v) as m from {name}_zl group by 1, 2),
{name}_x as (select key, rid, f, (v - m) / sd as v from {name}_xl join {name}_s using (key, f)),
{name}_z as (select key, rid, t, v - m as v from {name}_zl join {name}_b using (key, t))"""


def ridge(name: str, rows: str, alpha: str, scale: bool = True, scaling: str | None = None) -> str:
    """``name``(key, f, t, w): ridge weights of the (scaled) features of ``rows``(key, rid, x, z), intercept left out; and all that ``moments``
    gives. ``alpha`` is an expression of the key."""
    return f"""{moments(name, rows, scale, scaling)},
{name}_a as (select a.key, a.f, list(v order by g) as r from (
  select a.key, a.f, b.f as g, sum(a.v * b.v) + case when a.f = b.f then {alpha.replace('key', 'a.key')} else 0 end as v
  from {name}_x a join {name}_x b on a.key = b.key and a.rid = b.rid group by 1, 2, 3) a group by 1, 2),
{name}_c as (select key, f, list(v order by t) as r from (
  select a.key, a.f, b.t, sum(a.v * b.v) as v from {name}_x a join {name}_z b on a.key = b.key and a.rid = b.rid group by 1, 2, 3) group by 1, 2),
{name}_g as (select key, list(list_concat(a.r, c.r) order by f) as a, count(*) as n from {name}_a a join {name}_c c using (key, f) group by 1),
{eliminated(name + '_r', name + '_g')},
{name} as (select key, f, unnest(range(len(r) - n)) as t, unnest(r[n + 1:]) as w from (
  select key, len(a) as n, unnest(range(len(a))) as f, unnest(a) as r from {name}_r))"""


def predicted(name: str, model: str, rows: str) -> str:
    """``name``(key, rid, t, p) of ``rows``(key, rid, x) by the ridge ``model``."""
    return f"""{name}_l as (select key, rid, unnest(range(len(x))) as f, unnest(x)::double as v from {rows}),
{name} as (select a.key, a.rid, w.t, sum((a.v - s.m) / s.sd * w.w) + any_value(b.m) as p from {name}_l a join {model}_s s on a.key = s.key and a.f = s.f
  join {model} w on a.key = w.key and a.f = w.f join {model}_b b on a.key = b.key and w.t = b.t group by 1, 2, 3)"""
