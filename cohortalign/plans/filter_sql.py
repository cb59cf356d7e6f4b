"""Run cleaning as SQL: the Butterworth high-pass as a recursion over steps, and the chain around it.

Statements that use these expressions begin ``with recursive``.
"""

from .ridge_sql import predicted, ridge

STEP, CUTOFF_HZ, PAD = 1.333, 0.01, 18
_COS1, _COS2 = "cos(0.6 * pi())", "cos(0.8 * pi())"

#: Order 5 by the bilinear transform: a real pole p and two conjugate pairs, g the product of all gains.
_COEFFICIENTS = f"""wp as (select 4 * tan(pi() * {CUTOFF_HZ} * {STEP}::double) as w),
de as (select w, 16 - 8 * w * {_COS1} + w * w as d1, 16 - 8 * w * {_COS2} + w * w as d2 from wp),
co as (select 4 / (4 + w) * 16 / d1 * 16 / d2 as g, (4 - w) / (4 + w) as p, -2 * (16 - w * w) / d1 as a1, (16 + 8 * w * {_COS1} + w * w) / d1 as a2,
  -2 * (16 - w * w) / d2 as c1, (16 + 8 * w * {_COS2} + w * w) / d2 as c2 from de)"""


def _passed(name: str, rows: str) -> str:
    """``name``(run, voxel, w): the lists of ``rows``(run, voxel, w) filtered once, last step first. A constant equal to the first
    value went before."""
    return f"""{name}_f as (
  select run, voxel, w, 0::bigint as k, -g * w[1] as r, 0.0::double as s1, 0.0::double as s2, 0.0::double as u1, 0.0::double as u2, 0.0::double as y from {rows}, co
  union all
  select run, voxel, w, k + 1, p * y0 - g * x, s2 - 2 * y0 - a1 * y1, y0 - a2 * y1, u2 - 2 * y1 - c1 * y2, y1 - c2 * y2, y2 from (
    select *, y1 + u1 as y2 from (select *, y0 + s1 as y1 from (
      select f.*, co.*, w[k + 1] as x, g * w[k + 1] + r as y0 from {name}_f f, co where k < len(w))))),
{name} as (select run, voxel, list(y order by k desc) as w from {name}_f where k > 0 group by 1, 2)"""


def highpass(name: str, rows: str) -> str:
    """``name``(run, voxel, t, x): ``rows``(run, voxel, t, x) filtered forward and backward, with odd extensions of ``PAD`` steps."""
    return f"""{_COEFFICIENTS},
{name}_l as (select run, voxel, list(x::double order by t) as l, count(*) as n from {rows} group by 1, 2),
{name}_w as (select run, voxel, list_concat(list_transform(range({PAD}), lambda i: 2 * l[1] - l[{PAD} + 1 - i]), l,
  list_transform(range({PAD}), lambda i: 2 * l[n] - l[n - 1 - i])) as w from {name}_l),
{_passed(name + '_a', name + '_w')},
{_passed(name + '_b', name + '_a')},
{name} as (select run, voxel, unnest(range(len(w) - 2 * {PAD})) as t, unnest(w[{PAD} + 1 : len(w) - {PAD}]) as x from {name}_b)"""


def cleaned(fd_limit: float, max_share: float = 0.3, discard: int = 5, least: int = 30) -> str:
    """cl(run, voxel, t, x) of the views ``ts_`` and ``motion``: trimmed, detrended, filtered, censored, 24 confounds regressed out, z-scored."""
    move = " + ".join(f"abs(p{i} - lag(p{i}) over w)" + (" * 50.0" if i > 3 else "") for i in range(1, 7))
    base = [f"p{i}" for i in range(1, 7)] + [f"coalesce(p{i} - lag(p{i}) over w, 0)" for i in range(1, 7)]
    return f"""tr as (select run, voxel, t - {discard} as t, x from ts_ where t >= {discard} qualify count(*) over (partition by run, voxel) >= {least}),
dt as (select run, voxel, t, x - avg(x) over w - covar_pop(t, x) over w / var_pop(t) over w * (t - avg(t) over w) as x from tr window w as (partition by run, voxel)),
{highpass('hp', 'dt')},
fd as (select run, t - {discard} as t, coalesce({move}, 0) <= {fd_limit} as ok from motion where t >= {discard} window w as (partition by run order by t)),
ke as (select run, t from fd where ok or not ok qualify avg((not ok)::int) over (partition by run) <= {max_share} and ok),
cb as (select run, t, [{', '.join(base)}] as c from motion window w as (partition by run order by t)),
cf as (select run, t - {discard} as t, unnest(range(24)) as f, unnest(list_concat(c, list_transform(c, lambda x: x * x)))::double as v from cb),
cs as (select run, t, f, (v - avg(v) over w) / case when stddev_pop(v) over w < 1e-8 then 1 else stddev_pop(v) over w end as v from cf window w as (partition by run, f)),
cx as (select run, t, list(v order by f) as x from cs join ke using (run, t) group by 1, 2),
cz as (select run, t, list(x order by voxel) as z, list(voxel order by voxel) as vs from hp join ke using (run, t) group by 1, 2),
rw as (select run as key, t as rid, x, z from cx join cz using (run, t)),
{ridge('cw', 'rw', '0.0', False)}, {predicted('cp', 'cw', 'rw')},
re as (select cz.run, cz.vs[cp.t + 1] as voxel, cz.t, cz.z[cp.t + 1] - p as x from cp join cz on cp.key = cz.run and cp.rid = cz.t),
cl as (select run, voxel, t, (x - avg(x) over w) / greatest(stddev_pop(x) over w, 1e-8) as x from re window w as (partition by run, voxel))"""
