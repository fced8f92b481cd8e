"""Building blocks of the comparison SQL (DuckDB dialect): quantiles, smoothed modes, event times."""

from __future__ import annotations


def _on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def quantiles(name: str, src: str, keys: str, x: str, probs: dict[str, float]) -> str:
    """CTE ``name`` (keys, n, one column per probability), linear interpolation."""
    cols = []
    for c, p in probs.items():
        r = f"({p}::DOUBLE * (n - 1))"
        lo = f"max(CASE WHEN rn = floor({r}) THEN x END)"
        hi = f"max(CASE WHEN rn = least(floor({r}) + 1, n - 1) THEN x END)"
        cols.append(f"{lo} + ({hi} - {lo}) * ({r} - floor({r})) AS {c}")
    return f"""{name} AS (
  SELECT {keys}, n, {', '.join(cols)} FROM (
    SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY {keys}) AS n
    FROM (SELECT {keys}, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL)) GROUP BY {keys}, n)"""


def binned_peak(name: str, src: str, edges: str, keys: str, x: str, w: float, half: int) -> str:
    """CTEs up to ``name``_p (keys, a, nb, k, y0, y1, y2): first largest moving sum of the zero-filled histogram.

    ``edges`` is a CTE with keys, a (first edge) and nb (bins)."""
    k = f"floor((v.{x} - e.a) / {w})"
    return f"""{name}_c AS (
  SELECT {', '.join('v.' + c.strip() for c in keys.split(','))},
         CASE WHEN {k} = e.nb AND v.{x} = e.a + e.nb * {w}::DOUBLE THEN e.nb - 1 ELSE {k} END AS k, count(*) AS c
  FROM {src} v JOIN {edges} e ON {_on(keys, 'v', 'e')} WHERE v.{x} IS NOT NULL GROUP BY ALL),
{name}_z AS (SELECT e.*, CAST(g.k AS BIGINT) AS k, coalesce(h.c, 0) AS c FROM {edges} e, LATERAL (SELECT unnest(generate_series(0, CAST(e.nb AS BIGINT) - 1)) AS k) g
  LEFT JOIN {name}_c h ON {_on(keys, 'h', 'e')} AND h.k = g.k),
{name}_s AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS s FROM {name}_z),
{name}_n AS (SELECT *, lag(s) OVER (PARTITION BY {keys} ORDER BY k) AS y0, s AS y1, lead(s) OVER (PARTITION BY {keys} ORDER BY k) AS y2,
                    row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, k) AS rk FROM {name}_s),
{name}_p AS (SELECT * FROM {name}_n WHERE rk = 1)"""


SHIFT = """CASE WHEN k > 0 AND k < nb - 1 AND y0 - 2 * y1 + y2 <> 0
  THEN 0.5::DOUBLE * CAST(y0 - y2 AS DOUBLE) / CAST(y0 - 2 * y1 + y2 AS DOUBLE) ELSE 0 END"""


def mode(name: str, src: str, keys: str, x: str, w: float = 0.5, smooth: int = 5, min_count: int = 1, fixed: tuple | None = None) -> str:
    """CTE ``name`` (keys, n, mode)."""
    if fixed is None:
        q = quantiles(f"{name}_q", src, keys, x, {"lo": 0.01, "hi": 0.99})
        a = f"(lo - {w}::DOUBLE)"
        e = f"""{name}_e AS (SELECT {keys}, n, {a} AS a, ceil((hi + 2 * {w}::DOUBLE - {a}) / {w}::DOUBLE) - 1 AS nb FROM {name}_q WHERE n >= {min_count})"""
        pre = f"{q},\n{e}"
    else:
        import math
        nb = math.ceil((fixed[1] - fixed[0]) / w) - 1
        pre = f"""{name}_e AS (SELECT {keys}, count(*) AS n, {fixed[0]}::DOUBLE AS a, {nb} AS nb FROM {src} WHERE {x} IS NOT NULL GROUP BY {keys} HAVING count(*) >= {min_count})"""
    return f"""{pre},
{binned_peak(name, src, f'{name}_e', keys, x, w, smooth // 2)},
{name} AS (SELECT {keys}, n, a + {w}::DOUBLE * (k + 0.5::DOUBLE + {SHIFT}) AS mode FROM {name}_p)"""


def event_time(name: str, src: str, keys: str, x: str = "tau", window: float = 10.0, tails=(0.02, 0.98), passes: int = 2) -> str:
    """CTE ``name`` (keys, t_event)."""
    q = quantiles(f"{name}_q", src, keys, x, {"lo": tails[0], "hi": tails[1]})
    sel = lambda c, v: (f"SELECT {', '.join('v.' + k.strip() for k in keys.split(','))}, count(*) AS m, avg(v.{x}) AS c FROM {src} v "
                        f"JOIN {c} e ON {_on(keys, 'v', 'e')} WHERE abs(v.{x} - e.{v}) <= {window} GROUP BY ALL")
    out = f"""{q},
{name}_e AS (SELECT {keys}, lo - 4 AS a, ceil((hi + 6 - (lo - 4)) / 2) - 1 AS nb FROM {name}_q WHERE n >= 4),
{binned_peak(name, src, f'{name}_e', keys, x, 2.0, 1)},
{name}_0 AS (SELECT {keys}, a + 2.0 * k + 1.0 AS c FROM {name}_p),
{name}_1 AS ({sel(f'{name}_0', 'c')}),
"""
    if passes == 1:
        return out + f"{name} AS (SELECT {keys}, c AS t_event FROM {name}_1)"
    return out + f"""{name}_2 AS (SELECT * FROM {name}_1 WHERE m >= 4),
{name} AS (SELECT {keys}, c AS t_event FROM ({sel(f'{name}_2', 'c')}))"""


def primary(name: str, src: str, keys: str = "run, event") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, cable ORDER BY gain, t NULLS LAST, q, adc, atwd) AS rk
    FROM {src} WHERE found) WHERE rk = 1)"""


def tau_center(name: str, src: str, v: float, min_q: float) -> str:
    """Times corrected for the flight from the centre; sensors sit at 850 cm."""
    return f"""{name} AS (
  SELECT h.*, 650.0::DOUBLE AS d_ls, h.t - least(greatest(650.0::DOUBLE, 0), d) / {v}::DOUBLE - (d - 650.0::DOUBLE) / {v}::DOUBLE AS tau, d
  FROM {src} h JOIN (SELECT cable, sqrt(px * px + py * py + pz * pz) AS d FROM sensor) s ON h.cable = s.cable
  WHERE h.cable < 1879 AND h.t IS NOT NULL AND h.q >= {min_q})"""


def residuals(name: str, src: str, v: float = 17.6, min_q: float = 0.3) -> str:
    return f"""{tau_center(name + '_tau', src, v, min_q)},
{event_time(name + '_t', name + '_tau', 'run, event')},
{name} AS (SELECT h.*, h.tau - t.t_event AS res, t.t_event FROM {name}_tau h JOIN {name}_t t ON h.run = t.run AND h.event = t.event)"""
