"""Independent DuckDB SQL for every oracle-checked query (tables are pre-registered views).

Written separately from the Spark plans: leads become self-joins, exact percentiles are
``quantile_cont``, the bootstrap joins expanded draws instead of weights. Doubles are rounded
to 6 decimals, like the Spark side.
"""

from __future__ import annotations

EPOCH = "DATE '1995-01-01'"
W, H, M = 357, 4, 52
EST, ACT_LO, ACT_HI = W - (H + 104), W - 3 * H - 13, W - 3 * H - 1
TEST = W - H
CUTS = [(1, W - 2 * H), (2, W - 3 * H), (0, TEST)]
WINDOWS = (2, 4, 6, 8, 13, 26, 52)
HOLD, STOCK, CR = 1.0, 4.0, 0.8


def _cuts(p: str = "") -> str:
    vals = ", ".join(f"({f}, {c})" for f, c in CUTS)
    return f"{p}cuts AS (SELECT * FROM (VALUES {vals}) t(fold, cut))"


def sales(level: str = "region", signed: bool = False, p: str = "") -> str:
    store = "r.r_name" if level == "region" else "n.n_name"
    sold = "CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END" if signed else "l.l_quantity"
    return f"""{p}sales AS (
  SELECT p.p_brand AS item_id, {store} AS store_id, {sold} AS sold, CAST(l.l_shipdate AS DATE) AS date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def weekly(p: str = "", clip: bool = False) -> str:
    y = "greatest(CAST(sold AS DOUBLE), 0.0)" if clip else "CAST(sold AS DOUBLE)"
    return f"""{p}raw AS (SELECT store_id || '_' || item_id AS sid,
    CAST(floor((date - {EPOCH}) / 7.0) AS INTEGER) AS wk, {y} AS y FROM {p}sales),
{p}wsum AS (SELECT sid, wk, sum(y) AS y FROM {p}raw WHERE wk >= 0 AND wk < {W} GROUP BY sid, wk),
{p}series AS (SELECT DISTINCT sid FROM {p}raw),
{p}weekly AS (SELECT s.sid, CAST(g.wk AS INTEGER) AS wk,
    CAST({EPOCH} + CAST(7 * g.wk AS INTEGER) AS DATE) AS week_start, coalesce(w.y, 0.0) AS y
  FROM {p}series s CROSS JOIN range(0, {W}) g(wk) LEFT JOIN {p}wsum w ON w.sid = s.sid AND w.wk = g.wk)"""


def listed(p: str = "") -> str:
    return f"""{p}listed AS (SELECT sid, wk, week_start,
    CASE WHEN sum(y) OVER (PARTITION BY sid ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0
         THEN y END AS y FROM {p}weekly)"""


def elig(p: str = "") -> str:
    return f"""{p}eligagg AS (SELECT sid, min(CASE WHEN y > 0 THEN wk END) AS first_wk,
    sum(CASE WHEN wk BETWEEN {ACT_LO} AND {ACT_HI} THEN y ELSE 0.0 END) AS recent_sum FROM {p}weekly GROUP BY sid),
{p}elig AS (SELECT sid, first_wk, recent_sum FROM {p}eligagg WHERE first_wk <= {EST} AND recent_sum > 0)"""


def panel(level: str = "region", p: str = "") -> str:
    return ",\n".join([sales(level, p=p), weekly(p), listed(p), elig(p),
                       f"{p}panel AS (SELECT * FROM {p}listed WHERE sid IN (SELECT sid FROM {p}elig))"])


def sres(p: str = "") -> str:
    return f"""{p}sres AS (SELECT sid, wk, y - lag(y, {M}) OVER (PARTITION BY sid ORDER BY wk) AS r FROM {p}panel)"""


def sn_test(p: str = "", lo: float = 0.5, hi: float = CR) -> str:
    """Seasonal naive on the test window: {p}snt(sid, step, wk, q50, q_cr)."""
    return f"""{p}snq AS (SELECT sid, quantile_cont(r, {lo}) AS r50, quantile_cont(r, {hi}) AS rcr
    FROM {p}sres WHERE r IS NOT NULL AND wk < {TEST} GROUP BY sid),
{p}snt AS (SELECT p.sid, CAST(p.wk - {TEST - M} + 1 AS INTEGER) AS step, p.wk + {M} AS wk,
    greatest(p.y + q.r50, 0) AS q50, greatest(p.y + q.rcr, 0) AS q_cr
  FROM {p}panel p JOIN {p}snq q ON q.sid = p.sid WHERE p.wk >= {TEST - M} AND p.wk < {TEST - M + H})"""


def ma4_test(p: str = "") -> str:
    """Moving average window 4 on the test window: {p}mat(sid, step, wk, q50, q_cr)."""
    return f"""{p}m4 AS (SELECT sid, wk, CASE WHEN count(y) OVER w = 4 THEN avg(y) OVER w END AS mean FROM {p}panel
    WINDOW w AS (PARTITION BY sid ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
{p}m4r AS (SELECT m.sid, s.step, p.y - m.mean AS r FROM {p}m4 m CROSS JOIN range(1, {H + 1}) s(step)
    JOIN {p}panel p ON p.sid = m.sid AND p.wk = m.wk + s.step
    WHERE m.mean IS NOT NULL AND m.wk + {H} < {TEST} AND p.y IS NOT NULL),
{p}m4q AS (SELECT sid, step, quantile_cont(r, 0.5) AS r50, quantile_cont(r, {CR}) AS rcr FROM {p}m4r GROUP BY sid, step),
{p}mat AS (SELECT q.sid, CAST(q.step AS INTEGER) AS step, CAST({TEST} + q.step - 1 AS INTEGER) AS wk,
    greatest(m.mean + q.r50, 0) AS q50, greatest(m.mean + q.rcr, 0) AS q_cr
  FROM {p}m4q q JOIN {p}m4 m ON m.sid = q.sid AND m.wk = {TEST - 1})"""


def experiment(level: str, dataset: str, p: str) -> str:
    """Full rolling-origin experiment for one view. Produces {p}snps / {p}mps (fold, [k], sid,
    cost, demand, served, mae, mase), {p}val (k, cpu), {p}best (k), {p}cellps, {p}cells."""
    means = ",\n    ".join(f"CASE WHEN count(y) OVER w{k} = {k} THEN avg(y) OVER w{k} END AS m{k}" for k in WINDOWS)
    wins = ", ".join(f"w{k} AS (PARTITION BY sid ORDER BY wk ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
                     for k in WINDOWS)
    long = "\n  UNION ALL ".join(f"SELECT sid, wk, {k} AS k, m{k} AS mean FROM {p}mb WHERE m{k} IS NOT NULL"
                                 for k in WINDOWS)
    cost = f"{HOLD} * greatest(f.q_cr - t.y, 0) + {STOCK} * greatest(t.y - f.q_cr, 0)"
    score = f"""sum({cost}) AS cost, sum(t.y) AS demand, sum(least(f.q_cr, t.y)) AS served,
    avg(abs(t.y - f.q50)) AS mae"""
    return f"""{panel(level, p)},
{_cuts(p)},
{sres(p)},
{p}scl AS (SELECT c.fold, s.sid, avg(abs(s.r)) AS scale FROM {p}sres s JOIN {p}cuts c ON s.wk < c.cut
    WHERE s.r IS NOT NULL GROUP BY c.fold, s.sid),
{p}snq AS (SELECT c.fold, c.cut, s.sid, quantile_cont(s.r, 0.5) AS r50, quantile_cont(s.r, {CR}) AS rcr
    FROM {p}sres s JOIN {p}cuts c ON s.wk < c.cut WHERE s.r IS NOT NULL GROUP BY c.fold, c.cut, s.sid),
{p}snfc AS (SELECT q.fold, q.sid, p.wk + {M} AS wk, greatest(p.y + q.r50, 0) AS q50, greatest(p.y + q.rcr, 0) AS q_cr
    FROM {p}snq q JOIN {p}panel p ON p.sid = q.sid AND p.wk >= q.cut - {M} AND p.wk < q.cut - {M - H}),
{p}sns AS (SELECT f.fold, f.sid, {score} FROM {p}snfc f JOIN {p}panel t ON t.sid = f.sid AND t.wk = f.wk
    GROUP BY f.fold, f.sid),
{p}snps AS (SELECT a.*, a.mae / nullif(s.scale, 0) AS mase FROM {p}sns a LEFT JOIN {p}scl s ON s.fold = a.fold AND s.sid = a.sid),
{p}mb AS (SELECT sid, wk, y,
    {means}
  FROM {p}panel WINDOW {wins}),
{p}ml AS ({long}),
{p}mres AS (SELECT m.sid, m.wk, m.k, s.step, p.y - m.mean AS r FROM {p}ml m CROSS JOIN range(1, {H + 1}) s(step)
    JOIN {p}panel p ON p.sid = m.sid AND p.wk = m.wk + s.step WHERE p.y IS NOT NULL),
{p}mq AS (SELECT c.fold, c.cut, r.k, r.sid, r.step, quantile_cont(r.r, 0.5) AS r50, quantile_cont(r.r, {CR}) AS rcr
    FROM {p}mres r JOIN {p}cuts c ON r.wk + {H} < c.cut GROUP BY c.fold, c.cut, r.k, r.sid, r.step),
{p}mfc AS (SELECT q.fold, q.k, q.sid, q.cut + q.step - 1 AS wk, greatest(m.mean + q.r50, 0) AS q50,
    greatest(m.mean + q.rcr, 0) AS q_cr FROM {p}mq q JOIN {p}ml m ON m.sid = q.sid AND m.k = q.k AND m.wk = q.cut - 1),
{p}ms AS (SELECT f.fold, f.k, f.sid, {score} FROM {p}mfc f JOIN {p}panel t ON t.sid = f.sid AND t.wk = f.wk
    GROUP BY f.fold, f.k, f.sid),
{p}mps AS (SELECT a.*, a.mae / nullif(s.scale, 0) AS mase FROM {p}ms a LEFT JOIN {p}scl s ON s.fold = a.fold AND s.sid = a.sid),
{p}val AS (SELECT k, sum(cost) / sum(demand) AS cpu FROM {p}mps WHERE fold >= 1 GROUP BY k),
{p}snval AS (SELECT sum(cost) / sum(demand) AS cpu FROM {p}snps WHERE fold >= 1),
{p}best AS (SELECT k FROM {p}val ORDER BY cpu, k LIMIT 1),
{p}cellps AS (
  SELECT '{dataset}' AS dataset, 'seasonal_naive' AS model, 'statistical' AS regime, sid, cost, demand, served, mase,
         CAST(NULL AS INTEGER) AS k FROM {p}snps WHERE fold = 0
  UNION ALL SELECT '{dataset}', 'moving_average', 'zero_shot', sid, cost, demand, served, mase, k
         FROM {p}mps WHERE fold = 0 AND k = 4
  UNION ALL SELECT '{dataset}', 'moving_average', 'fine_tune', sid, cost, demand, served, mase, k
         FROM {p}mps WHERE fold = 0 AND k = (SELECT k FROM {p}best)),
{p}cells AS (SELECT dataset, model, regime, avg(mase) AS MASE, quantile_cont(mase, 0.5) AS MASE_median,
    sum(cost) / sum(demand) AS cost_per_unit, sum(served) / sum(demand) AS fill_rate, count(*) AS n_series,
    max(k) AS window FROM {p}cellps GROUP BY dataset, model, regime)"""


def config_cells(p: str, dataset: str) -> str:
    """Every configuration as a cell: {p}cfgps."""
    return f"""{p}cfgps AS (
  SELECT '{dataset}' AS dataset, 'seasonal_naive' AS model, 'statistical' AS regime, sid, cost, demand, served, mase
    FROM {p}snps WHERE fold = 0
  UNION ALL SELECT '{dataset}', 'moving_average', 'window_' || lpad(CAST(k AS VARCHAR), 2, '0'), sid, cost, demand,
    served, mase FROM {p}mps WHERE fold = 0)"""


RESAMPLES = 10_000
SLICE = 4096
_TWO64 = "18446744073709551616::HUGEINT"


def _bits(name: str, src: str, place: str, draw: str) -> str:
    """CTE ``name``: ``src`` (with b) and 64 random bits u of draw ``draw`` at ``place``, as the README's draw rule has them."""
    start = (f"(b::HUGEINT * {0x1E3779B97F4A7C15} + ({draw})::HUGEINT * {0x2545F4914F6CDD1D} + ({place})::HUGEINT * {0x3C79AC492BA7B653}"
             f" + 51::HUGEINT * {0x1C69B3F74AC4AE35}) % {_TWO64}")
    return f"""{name} AS (SELECT * EXCLUDE (z0, z1, z2), xor(z2, z2 >> 32) AS u FROM (
  SELECT *, CAST(CAST(xor(z1, z1 >> 29) AS HUGEINT) * {0x14D049BB133111EB} % {_TWO64} AS UBIGINT) AS z2 FROM (
  SELECT *, CAST(CAST(xor(z0, z0 >> 32) AS HUGEINT) * {0x3F58476D1CE4E5B9} % {_TWO64} AS UBIGINT) AS z1 FROM (
  SELECT *, CAST({start} AS UBIGINT) AS z0 FROM {src}))))"""


def bootstrap(src: str, resamples: int = RESAMPLES, p: str = "bs_") -> str:
    """Replicate statistics from expanded draws: {p}obs, {p}rl (per cell, b, metric, v), {p}ids."""
    return f"""{p}ids AS (SELECT dataset, sid, row_number() OVER (PARTITION BY dataset ORDER BY sid) - 1 AS pos,
    count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, sid FROM {src})),
{p}sizes AS (SELECT DISTINCT dataset, n FROM {p}ids),
{p}idx AS (SELECT z.dataset, z.n, b.b, unnest(range(0, z.n)) AS i FROM {p}sizes z CROSS JOIN range(0, {resamples}) b(b)),
{p}many AS (SELECT * FROM {p}idx WHERE n > {SLICE}),
{_bits(p + 'first', p + 'many', '0', 'i')},
{p}dealt AS (SELECT dataset, n, b, s, row_number() OVER (PARTITION BY dataset, b, s ORDER BY i) - 1 AS j
    FROM (SELECT *, u % n // {SLICE} AS s FROM {p}first)
  UNION ALL SELECT dataset, n, b, 0, i FROM {p}idx WHERE n <= {SLICE}),
{_bits(p + 'second', p + 'dealt', 's + 1', 'j')},
{p}draws AS (SELECT dataset, b, CAST(s * {SLICE} + u % CAST(least({SLICE}, n - s * {SLICE}) AS UBIGINT) AS BIGINT) AS pos FROM {p}second),
{p}rs AS (SELECT c.dataset, c.model, c.regime, d.b, avg(c.mase) AS MASE, quantile_cont(c.mase, 0.5) AS MASE_median,
    sum(c.cost) / sum(c.demand) AS cost_per_unit
  FROM {p}draws d JOIN {p}ids i ON i.dataset = d.dataset AND i.pos = d.pos
  JOIN {src} c ON c.dataset = i.dataset AND c.sid = i.sid GROUP BY c.dataset, c.model, c.regime, d.b),
{p}obs AS (SELECT dataset, model, regime, avg(mase) AS MASE, quantile_cont(mase, 0.5) AS MASE_median,
    sum(cost) / sum(demand) AS cost_per_unit FROM {src} GROUP BY dataset, model, regime),
{p}rl AS (SELECT dataset, model, regime, b, 'MASE' AS metric, MASE AS v FROM {p}rs
  UNION ALL SELECT dataset, model, regime, b, 'MASE_median', MASE_median FROM {p}rs
  UNION ALL SELECT dataset, model, regime, b, 'cost_per_unit', cost_per_unit FROM {p}rs),
{p}ol AS (SELECT dataset, model, regime, 'MASE' AS metric, MASE AS v FROM {p}obs
  UNION ALL SELECT dataset, model, regime, 'MASE_median', MASE_median FROM {p}obs
  UNION ALL SELECT dataset, model, regime, 'cost_per_unit', cost_per_unit FROM {p}obs)"""


def pair_tests(p: str = "bs_", pair_filter: str | None = None) -> str:
    cond = pair_filter or "(a.model < b.model OR (a.model = b.model AND a.regime < b.regime))"
    return f"""{p}pr AS (SELECT a.dataset, a.model AS model_a, a.regime AS regime_a, b.model AS model_b,
    b.regime AS regime_b, a.metric, avg(CASE WHEN round(a.v - b.v, 9) <= 0 THEN 1.0 ELSE 0.0 END) AS below,
    avg(CASE WHEN round(a.v - b.v, 9) >= 0 THEN 1.0 ELSE 0.0 END) AS above
  FROM {p}rl a JOIN {p}rl b ON a.dataset = b.dataset AND a.b = b.b AND a.metric = b.metric
  WHERE {cond}
  GROUP BY a.dataset, a.model, a.regime, b.model, b.regime, a.metric),
{p}res AS (SELECT t.dataset, t.model_a, t.regime_a, t.model_b, t.regime_b, t.metric, oa.v AS a, ob.v AS b,
    oa.v - ob.v AS diff, least(1.0, 2 * least(t.below, t.above)) AS p_value, z.n
  FROM {p}pr t JOIN {p}ol oa ON oa.dataset = t.dataset AND oa.model = t.model_a AND oa.regime = t.regime_a
    AND oa.metric = t.metric
  JOIN {p}ol ob ON ob.dataset = t.dataset AND ob.model = t.model_b AND ob.regime = t.regime_b AND ob.metric = t.metric
  JOIN {p}sizes z ON z.dataset = t.dataset)"""


PAIR_COLS = "dataset, model_a, regime_a, model_b, regime_b, metric, round(a, 6) AS a, round(b, 6) AS b, " \
            "round(diff, 6) AS diff, round(p_value, 6) AS p_value, n"


def daily(p: str = "") -> str:
    return f"""{p}bounds AS (SELECT min(date) AS d0, max(date) AS d1 FROM {p}sales),
{p}dsum AS (SELECT item_id, store_id, date, sum(CAST(sold AS DOUBLE)) AS sold FROM {p}sales GROUP BY item_id, store_id, date),
{p}dser AS (SELECT DISTINCT item_id, store_id FROM {p}dsum),
{p}cal AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM {p}bounds),
{p}dp AS (SELECT s.item_id, s.store_id, c.date, coalesce(d.sold, 0.0) AS sold FROM {p}dser s CROSS JOIN {p}cal c
    LEFT JOIN {p}dsum d ON d.item_id = s.item_id AND d.store_id = s.store_id AND d.date = c.date)"""


def next_month(p: str = "") -> str:
    return f"""{sales('region', p=p)},
{daily(p)},
{p}db AS (SELECT store_id, item_id, date, CASE WHEN count(sold) OVER w = 28 THEN avg(sold) OVER w END AS mean FROM {p}dp
    WINDOW w AS (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
{p}last AS (SELECT max(date) AS d1 FROM {p}dp),
{p}dres AS (SELECT b.store_id, b.item_id, s.step, d.sold - b.mean AS r FROM {p}db b CROSS JOIN range(1, 29) s(step)
    JOIN {p}dp d ON d.store_id = b.store_id AND d.item_id = b.item_id AND d.date = b.date + CAST(s.step AS INTEGER)
    WHERE b.mean IS NOT NULL AND b.date + 28 <= (SELECT d1 FROM {p}last)),
{p}dq AS (SELECT store_id, item_id, step, quantile_cont(r, {CR}) AS rq FROM {p}dres GROUP BY store_id, item_id, step),
{p}dpt AS (SELECT store_id, item_id, mean AS point, date AS d_end FROM {p}db WHERE date = (SELECT d1 FROM {p}last)),
{p}nm AS (SELECT q.store_id, q.item_id, CAST(p.d_end + CAST(q.step AS INTEGER) AS DATE) AS forecasted_date,
    CAST(round_even(greatest(p.point + q.rq, 0), 0) AS BIGINT) AS forecasted_sold
  FROM {p}dq q JOIN {p}dpt p ON p.store_id = q.store_id AND p.item_id = q.item_id),
{p}plan AS (SELECT store_id, item_id, CAST(sum(forecasted_sold) AS BIGINT) AS forecasted_sold FROM {p}nm
    GROUP BY store_id, item_id HAVING sum(forecasted_sold) <> 0)"""


def company_plans() -> str:
    """``next_month`` for every region as a company, with a calendar of its own."""
    return f"""csales AS (
  SELECT r.r_regionkey AS company_id, substr(p.p_brand, 1, 7) AS item_id, n.n_name AS store_id, l.l_quantity AS sold, CAST(l.l_shipdate AS DATE) AS date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
bounds AS (SELECT company_id, min(date) AS d0, max(date) AS d1 FROM csales GROUP BY company_id),
dsum AS (SELECT company_id, item_id, store_id, date, sum(CAST(sold AS DOUBLE)) AS sold FROM csales GROUP BY ALL),
cal AS (SELECT company_id, d1, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
dp AS (SELECT s.company_id, s.item_id, s.store_id, c.d1, c.date, coalesce(d.sold, 0.0) AS sold
  FROM (SELECT DISTINCT company_id, item_id, store_id FROM dsum) s JOIN cal c USING (company_id)
  LEFT JOIN dsum d ON d.company_id = s.company_id AND d.item_id = s.item_id AND d.store_id = s.store_id AND d.date = c.date),
db AS (SELECT *, CASE WHEN count(sold) OVER w = 28 THEN avg(sold) OVER w END AS mean FROM dp
  WINDOW w AS (PARTITION BY company_id, store_id, item_id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
dres AS (SELECT b.company_id, b.store_id, b.item_id, s.step, d.sold - b.mean AS r FROM db b CROSS JOIN range(1, 29) s(step)
  JOIN dp d ON d.company_id = b.company_id AND d.store_id = b.store_id AND d.item_id = b.item_id AND d.date = b.date + CAST(s.step AS INTEGER)
  WHERE b.mean IS NOT NULL AND b.date + 28 <= b.d1),
dq AS (SELECT company_id, store_id, item_id, step, quantile_cont(r, {CR}) AS rq FROM dres GROUP BY ALL),
nm AS (SELECT q.company_id, q.store_id, q.item_id, CAST(round_even(greatest(b.mean + q.rq, 0), 0) AS BIGINT) AS forecasted_sold
  FROM dq q JOIN db b ON b.company_id = q.company_id AND b.store_id = q.store_id AND b.item_id = q.item_id AND b.date = b.d1)"""


APP = """app AS (SELECT CAST(s.s_nationkey AS BIGINT) AS company_id, s.s_name AS store_id, p.p_name AS item_id,
    l.l_quantity AS sold, CAST(l.l_shipdate AS DATE) AS date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def _w(body: str, select: str) -> str:
    return f"WITH {body}\n{select}"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    R = panel("region")
    N = panel("nation")
    hist_r = f"{R},\n{sres()}"

    q["export_company_sales"] = """SELECT s.s_name AS store_id, p.p_name AS item_id, round(l.l_quantity, 6) AS sold,
    CAST(l.l_shipdate AS DATE) AS date FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = 7"""
    q["sales_quality"] = _w(sales("nation", signed=True), """SELECT 'good' AS status, count(*) AS n_rows,
    round(sum(sold), 6) AS units FROM sales WHERE sold >= 0
  UNION ALL SELECT 'rejected', count(*), round(sum(sold), 6) FROM sales WHERE sold < 0 OR sold IS NULL""")
    q["dim_upsert"] = _w(APP + """,
fp AS (SELECT DISTINCT company_id, item_id AS name FROM app WHERE date < DATE '1998-01-01'),
bp AS (SELECT DISTINCT company_id, item_id AS name FROM app WHERE date >= DATE '1998-01-01'),
fs AS (SELECT DISTINCT company_id, store_id AS name FROM app WHERE date < DATE '1998-01-01'),
bs AS (SELECT DISTINCT company_id, store_id AS name FROM app WHERE date >= DATE '1998-01-01')""",
        """SELECT company_id, 'product' AS kind, name, false AS is_new FROM fp
  UNION ALL SELECT company_id, 'product', name, true FROM bp b
    WHERE NOT EXISTS (SELECT 1 FROM fp f WHERE f.company_id = b.company_id AND f.name = b.name)
  UNION ALL SELECT company_id, 'store', name, false FROM fs
  UNION ALL SELECT company_id, 'store', name, true FROM bs b
    WHERE NOT EXISTS (SELECT 1 FROM fs f WHERE f.company_id = b.company_id AND f.name = b.name)""")
    q["sales_keyed"] = _w(APP + """,
prod AS (SELECT a.company_id, a.item_id, min(p.p_partkey) AS product_key
  FROM (SELECT DISTINCT company_id, item_id FROM app) a JOIN part p ON p.p_name = a.item_id GROUP BY a.company_id, a.item_id)""",
        """SELECT a.company_id, s.s_suppkey AS store_key, pr.product_key, count(*) AS n_rows, round(sum(a.sold), 6) AS units
  FROM app a JOIN supplier s ON s.s_name = a.store_id AND CAST(s.s_nationkey AS BIGINT) = a.company_id
  JOIN prod pr ON pr.company_id = a.company_id AND pr.item_id = a.item_id
  GROUP BY a.company_id, s.s_suppkey, pr.product_key""")
    q["company_upsert"] = _w("""cur AS (SELECT CAST(n_nationkey + 1000 AS BIGINT) AS user_id, CAST(n_nationkey AS BIGINT) AS company_id,
    n_name AS name FROM nation),
upd AS (SELECT CAST(r_regionkey + 1000 AS BIGINT) AS user_id, CAST(r_regionkey AS BIGINT) AS company_id,
    r_name || ' CO' AS name FROM region
  UNION ALL SELECT CAST(r_regionkey + 2000 AS BIGINT), CAST(r_regionkey + 100 AS BIGINT), 'NEW ' || r_name FROM region)""",
        """SELECT coalesce(u.user_id, c.user_id) AS user_id, coalesce(u.company_id, c.company_id) AS company_id,
    coalesce(u.name, c.name) AS name FROM cur c FULL OUTER JOIN upd u ON c.user_id = u.user_id""")
    q["store_locations"] = """SELECT CAST(s.s_nationkey AS BIGINT) AS company_id, s.s_name AS name,
    round(CASE WHEN s.s_nationkey = 7 THEN CAST(n.n_nationkey * 3 AS DOUBLE)
               WHEN s.s_acctbal >= 0 THEN s.s_acctbal / 250.0 ELSE 33.8938 END, 6) AS lat,
    round(CASE WHEN s.s_nationkey = 7 THEN CAST(n.n_regionkey * 10 AS DOUBLE)
               WHEN s.s_acctbal >= 0 THEN CAST(s.s_nationkey * 7 - 80 AS DOUBLE) ELSE 35.5018 END, 6) AS lon
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey"""
    q["next_month_forecast"] = _w(next_month(), "SELECT store_id, item_id, forecasted_date, forecasted_sold FROM nm")
    q["order_plan"] = _w(next_month(), "SELECT store_id, item_id, forecasted_sold FROM plan")
    q["company_order_plan"] = _w(company_plans(), """SELECT CAST(company_id AS BIGINT) AS company_id, store_id, item_id,
    CAST(sum(forecasted_sold) AS BIGINT) AS forecasted_sold FROM nm GROUP BY ALL HAVING sum(forecasted_sold) <> 0""")
    q["plan_by_location"] = _w(next_month(), """SELECT p.store_id, p.item_id, p.forecasted_sold,
    round(CAST(r.r_regionkey * 15.0 - 30.0 AS DOUBLE), 6) AS lat, round(CAST(r.r_regionkey * 40.0 - 90.0 AS DOUBLE), 6) AS lon
  FROM plan p JOIN region r ON r.r_name = p.store_id""")

    q["daily_panel"] = _w(f"{sales('region')},\n{daily()}", """SELECT item_id, store_id, count(*) AS days,
    round(sum(sold), 6) AS total, count(CASE WHEN sold = 0 THEN 1 END) AS zero_days FROM dp GROUP BY item_id, store_id""")
    q["weekly_panel"] = _w(f"{sales('region')},\n{weekly()}", "SELECT sid, wk, week_start, round(y, 6) AS y FROM weekly")
    q["wide_to_weekly"] = q["weekly_panel"]
    q["weekly_panel_returns"] = _w(f"{sales('region', signed=True)},\n{weekly(clip=True)}",
                                   "SELECT sid, wk, week_start, round(y, 6) AS y FROM weekly")
    q["listed_panel"] = _w(N, "SELECT sid, wk, round(y, 6) AS y FROM listed")
    q["long_frame"] = _w(N, "SELECT sid AS unique_id, week_start AS ds, round(y, 6) AS y FROM listed WHERE y IS NOT NULL")
    q["eligible_series"] = _w(N, "SELECT sid, first_wk, round(recent_sum, 6) AS recent_sum FROM elig")
    q["sampled_panel"] = _w(N + """,
ids AS (SELECT sid FROM elig ORDER BY ('0x' || substr(md5('51:' || sid), 1, 8))::BIGINT, sid LIMIT 1000)""",
                            "SELECT sid, wk, round(y, 6) AS y FROM listed WHERE sid IN (SELECT sid FROM ids)")
    q["series_starts"] = _w(N, "SELECT sid, min(CASE WHEN y IS NOT NULL THEN week_start END) AS start FROM listed GROUP BY sid")
    q["series_arrays"] = _w(N, """SELECT sid, min(week_start) AS start, CAST(count(*) AS INTEGER) AS length,
    round(arg_min(y, wk), 6) AS first, round(arg_max(y, wk), 6) AS last, round(sum(y), 6) AS total
  FROM listed WHERE y IS NOT NULL GROUP BY sid""")
    q["fold_splits"] = _w(R, f"""SELECT f.fold, p.sid, count(CASE WHEN p.wk < f.cut AND p.y IS NOT NULL THEN 1 END) AS n_train,
    round(sum(CASE WHEN p.wk < f.cut THEN p.y END), 6) AS sum_train,
    round(sum(CASE WHEN p.wk >= f.cut THEN p.y END), 6) AS sum_truth
  FROM panel p JOIN (VALUES (1, {W - 2 * H}), (2, {W - 3 * H})) f(fold, cut) ON p.wk < f.cut + {H} GROUP BY f.fold, p.sid""")
    weeks = ", ".join(f"round(coalesce(sum(CASE WHEN wk = {w} THEN y END), 0), 6) AS w{w}" for w in range(W))
    q["weekly_panel_wide"] = _w(f"{sales('region')},\n{weekly()}", f"SELECT sid, {weeks} FROM weekly GROUP BY sid")
    q["panel_profile"] = _w(N + """,
per AS (SELECT sid, avg(y) AS mean_demand, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_share,
    CAST(357 - min(wk) AS DOUBLE) AS weeks_since_first
  FROM listed WHERE y IS NOT NULL AND sid IN (SELECT sid FROM elig) GROUP BY sid)""",
        """SELECT c.series, c.eligible, round(c.eligible / c.series, 6) AS eligible_share, 357 AS weeks,
    round(m.a, 6) AS median_weeks_since_first, round(m.b, 6) AS median_mean_demand, round(m.c, 6) AS median_zero_share
  FROM (SELECT (SELECT count(DISTINCT sid) FROM weekly) AS series, (SELECT count(*) FROM elig) AS eligible) c,
       (SELECT quantile_cont(weeks_since_first, 0.5) AS a, quantile_cont(mean_demand, 0.5) AS b,
               quantile_cont(zero_share, 0.5) AS c FROM per) m""")
    q["cost_parameters"] = """WITH base AS (SELECT p.p_brand AS b, r.r_name AS rn, n.n_name AS nn
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
v AS (SELECT 'brand_region' AS dataset, count(DISTINCT rn || '_' || b) AS n_series FROM base
  UNION ALL SELECT 'brand_nation', count(DISTINCT nn || '_' || b) FROM base),
c AS (SELECT cost_set, CAST(h AS DOUBLE) AS holding, CAST(s AS DOUBLE) AS stockout
  FROM (VALUES ('m5', 1.0, 4.0), ('favorita', 1.0, 2.0)) t(cost_set, h, s))
SELECT v.dataset, c.cost_set, v.n_series, round(c.holding, 6) AS holding, round(c.stockout, 6) AS stockout,
    round(c.stockout / (c.stockout + c.holding), 6) AS critical_ratio, CAST(0.5 AS DOUBLE) AS q_lo,
    round(c.stockout / (c.stockout + c.holding), 6) AS q_hi FROM v CROSS JOIN c"""

    # ---- features
    q["seasonal_residuals"] = _w(hist_r, "SELECT sid, wk, round(r, 6) AS residual FROM sres WHERE r IS NOT NULL")
    q["trailing_mean"] = _w(R + """,
tm AS (SELECT sid, wk, CASE WHEN count(y) OVER w = 4 THEN avg(y) OVER w END AS mean FROM panel
  WINDOW w AS (PARTITION BY sid ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
                             "SELECT sid, wk, round(mean, 6) AS mean FROM tm WHERE mean IS NOT NULL")
    q["moving_average_residuals"] = _w(f"{R},\n{ma4_test()}", """SELECT sid, CAST(step AS INTEGER) AS step,
    count(*) AS n, round(avg(r), 6) AS avg, round(min(r), 6) AS min, round(max(r), 6) AS max FROM m4r GROUP BY sid, step""")
    sw = f"""{R},
hw AS (SELECT sid, wk,
    count(y) OVER (PARTITION BY sid ORDER BY wk ROWS BETWEEN 55 PRECEDING AND CURRENT ROW) AS cnt,
    sum(y) OVER (PARTITION BY sid ORDER BY wk ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING) AS sx,
    sum(y) OVER (PARTITION BY sid ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS sy,
    lag(y, 3) OVER (PARTITION BY sid ORDER BY wk) AS t0, lag(y, 2) OVER (PARTITION BY sid ORDER BY wk) AS t1,
    lag(y, 1) OVER (PARTITION BY sid ORDER BY wk) AS t2, y AS t3,
    lag(y, 4) OVER (PARTITION BY sid ORDER BY wk) AS xl
  FROM panel WHERE wk < {TEST}),
win AS (SELECT *, 1 + sx / 52.0 AS scale FROM hw WHERE cnt = 56)"""
    q["scaled_windows"] = _w(sw, """SELECT sid, count(*) AS n_windows, round(sum(sx / scale), 6) AS sum_x,
    round(sum(sy / scale), 6) AS sum_y FROM win GROUP BY sid""")
    q["design_matrix"] = _w(sw, """SELECT step, count(*) AS n_rows, round(sum(t), 6) AS sum_target,
    round(sum(xl / scale), 6) AS sum_last_lag
  FROM (SELECT 0 AS step, t0 / scale AS t, xl, scale FROM win UNION ALL SELECT 1, t1 / scale, xl, scale FROM win
        UNION ALL SELECT 2, t2 / scale, xl, scale FROM win UNION ALL SELECT 3, t3 / scale, xl, scale FROM win) x
  GROUP BY step""")
    q["latest_context"] = _w(R, f"""SELECT sid, CAST(count(y) AS INTEGER) AS n, round(sum(y) / count(y) + 1, 6) AS scale
  FROM panel WHERE wk >= {TEST - 52} AND wk < {TEST} AND y IS NOT NULL GROUP BY sid""")
    q["residual_quantiles"] = _w(hist_r, f"""SELECT sid, round(quantile_cont(r, 0.5), 6) AS r50,
    round(quantile_cont(r, 0.8), 6) AS r80 FROM sres WHERE r IS NOT NULL AND wk < {TEST} GROUP BY sid""")
    q["seasonal_scale"] = _w(hist_r, f"""SELECT sid, round(avg(abs(r)), 6) AS scale FROM sres
  WHERE r IS NOT NULL AND wk < {TEST} GROUP BY sid""")

    # ---- forecasts
    sn = f"{hist_r},\n{sn_test()}"
    q["seasonal_naive_forecast"] = _w(sn, "SELECT sid, step, round(q50, 6) AS q50, round(q_cr, 6) AS q_cr FROM snt")
    q["udf_forecast"] = q["seasonal_naive_forecast"]
    q["uncross_quantiles"] = _w(f"{hist_r},\n{sn_test(lo=CR, hi=0.5)}", """SELECT sid, step,
    round(least(q50, q_cr), 6) AS q50, round(greatest(q50, q_cr), 6) AS q_cr FROM snt""")
    q["moving_average_forecast"] = _w(f"{R},\n{ma4_test()}",
                                      "SELECT sid, step, round(q50, 6) AS q50, round(q_cr, 6) AS q_cr FROM mat")
    q["sample_path_quantiles"] = _w(f"""{hist_r},
rk AS (SELECT sid, r, row_number() OVER (PARTITION BY sid ORDER BY wk) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n
  FROM sres WHERE r IS NOT NULL AND wk < {TEST}),
pts AS (SELECT sid, CAST(wk - {TEST - M} + 1 AS INTEGER) AS step, y AS point FROM panel
  WHERE wk >= {TEST - M} AND wk < {TEST - M + H}),
sz AS (SELECT DISTINCT sid, n FROM rk),
dr AS (SELECT p.sid, p.step, p.point,
    ('0x' || substr(md5('51:' || p.sid || ':' || CAST(p.step AS VARCHAR) || ':' || CAST(j.j AS VARCHAR)), 1, 8))::BIGINT
      % z.n AS pos
  FROM pts p JOIN sz z ON z.sid = p.sid CROSS JOIN range(0, 100) j(j)),
paths AS (SELECT d.sid, d.step, greatest(d.point + k.r, 0) AS path FROM dr d JOIN rk k ON k.sid = d.sid AND k.pos = d.pos)""",
        """SELECT sid, step, round(quantile_cont(path, 0.5), 6) AS q50, round(quantile_cont(path, 0.8), 6) AS q_cr
  FROM paths GROUP BY sid, step""")
    q["pinball_loss"] = _w(f"{hist_r},\n{sn_test()},\n{ma4_test()}" + """,
fc AS (SELECT 'seasonal_naive' AS model, sid, wk, q50, q_cr FROM snt
  UNION ALL SELECT 'moving_average', sid, wk, q50, q_cr FROM mat),
j AS (SELECT f.model, f.q50, f.q_cr, p.y FROM fc f JOIN panel p ON p.sid = f.sid AND p.wk = f.wk)""",
        """SELECT model, CAST(0.5 AS DOUBLE) AS level,
    round(avg(greatest(0.5 * (y - q50), (0.5 - 1) * (y - q50))), 6) AS loss FROM j GROUP BY model
  UNION ALL SELECT model, CAST(0.8 AS DOUBLE), round(avg(greatest(0.8 * (y - q_cr), (0.8 - 1) * (y - q_cr))), 6)
  FROM j GROUP BY model""")
    parts = []
    for name, h, s in (("m5", 1.0, 4.0), ("favorita", 1.0, 2.0)):
        cr = s / (s + h)
        parts.append((name, h, s, cr))
    nv_body = hist_r
    sels = []
    for name, h, s, cr in parts:
        nv_body += ",\n" + sn_test(p=f"{name}_", lo=0.5, hi=repr(cr)).replace(f"FROM {name}_sres", "FROM sres") \
            .replace(f"FROM {name}_panel", "FROM panel")
        sels.append(f"""SELECT '{name}' AS cost_set,
    round(sum({h} * greatest(f.q_cr - p.y, 0) + {s} * greatest(p.y - f.q_cr, 0)), 6) AS total_cost,
    round(sum({h} * greatest(f.q_cr - p.y, 0) + {s} * greatest(p.y - f.q_cr, 0)) / sum(p.y), 6) AS cost_per_unit,
    round(sum(least(f.q_cr, p.y)) / sum(p.y), 6) AS fill_rate
  FROM {name}_snt f JOIN panel p ON p.sid = f.sid AND p.wk = f.wk""")
    q["newsvendor_cost"] = _w(nv_body, "\nUNION ALL ".join(sels))
    q["forecast_accuracy"] = _w(f"""{sn},
t AS (SELECT f.sid, avg(abs(p.y - f.q50)) AS mae FROM snt f JOIN panel p ON p.sid = f.sid AND p.wk = f.wk GROUP BY f.sid),
s AS (SELECT sid, avg(abs(r)) AS scale FROM sres WHERE r IS NOT NULL AND wk < {TEST} GROUP BY sid)""",
        """SELECT t.sid, round(t.mae, 6) AS mae, round(s.scale, 6) AS scale, round(t.mae / nullif(s.scale, 0), 6) AS mase
  FROM t LEFT JOIN s ON s.sid = t.sid""")

    # ---- experiment and report
    ER = experiment("region", "brand_region", "")
    EN = experiment("nation", "brand_nation", "n_")
    both = f"{ER},\n{EN},\nallcells AS (SELECT * FROM cells UNION ALL SELECT * FROM n_cells),\n" \
           f"allps AS (SELECT * FROM cellps UNION ALL SELECT * FROM n_cellps)"
    q["per_series_scores"] = _w(ER, """SELECT dataset, model, regime, sid, round(cost, 6) AS cost, round(demand, 6) AS demand,
    round(mase, 6) AS mase FROM cellps""")
    summ = """avg(mase) AS MASE, quantile_cont(mase, 0.5) AS MASE_median, sum(cost) / sum(demand) AS cost_per_unit,
    sum(served) / sum(demand) AS fill_rate, count(*) AS n_series"""
    q["cell_summary"] = _w(f"""{ER},
cs AS (SELECT 'seasonal_naive' AS model, '{{}}' AS params, {summ} FROM snps WHERE fold = 0
  UNION ALL SELECT 'moving_average', '{{"window": ' || CAST(k AS VARCHAR) || '}}', {summ} FROM mps WHERE fold = 0 GROUP BY k)""",
        """SELECT model, params, round(MASE, 6) AS MASE, round(MASE_median, 6) AS MASE_median,
    round(cost_per_unit, 6) AS cost_per_unit, round(fill_rate, 6) AS fill_rate, n_series FROM cs""")
    gidx = "CASE k " + " ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(WINDOWS)) + " END"
    q["tuning_trials"] = _w(ER, f"""SELECT CAST({gidx} AS INTEGER) AS grid_idx, CAST(k AS INTEGER) AS window,
    round(cpu, 6) AS cost_per_unit FROM val""")
    q["best_params"] = _w(ER, """SELECT CAST(k AS INTEGER) AS window, round(cpu, 6) AS cost_per_unit FROM val
  ORDER BY cpu, k LIMIT 1""")
    q["tuning_summary"] = _w(f"""{ER},
tr AS (SELECT 'seasonal_naive' AS model, 'statistical' AS regime, cpu FROM snval
  UNION ALL SELECT 'moving_average', 'fine_tune', cpu FROM val
  UNION ALL SELECT 'moving_average', 'zero_shot', cpu FROM val WHERE k = 4)""",
        """SELECT 'brand_region' AS dataset, model, regime, count(*) AS configs, round(min(cpu), 6) AS best,
    round(max(cpu), 6) AS worst FROM tr GROUP BY model, regime""")
    q["leaderboard"] = _w(both, """SELECT dataset,
    CAST(row_number() OVER (PARTITION BY dataset ORDER BY cost_per_unit, model, regime) AS INTEGER) AS place,
    model, regime, round(cost_per_unit, 6) AS cost_per_unit FROM allcells""")
    q["best_built"] = _w(both, """SELECT dataset, arg_min(model, (cost_per_unit, model, regime)) AS model,
    arg_min(regime, (cost_per_unit, model, regime)) AS regime, round(min(cost_per_unit), 6) AS cost_per_unit
  FROM allcells WHERE model IN ('seasonal_naive', 'moving_average', 'quantile_forest') GROUP BY dataset""")
    q["significance"] = _w(f"{both},\n{bootstrap('allps')},\n{pair_tests()}", f"SELECT {PAIR_COLS} FROM bs_res")
    q["bootstrap_pairs"] = _w(f"{ER},\n{config_cells('', 'brand_region')},\n{bootstrap('cfgps')},\n{pair_tests()}",
                              f"SELECT {PAIR_COLS} FROM bs_res")
    planned = ("((a.model = 'moving_average' AND a.regime = 'zero_shot' AND b.model = 'seasonal_naive') OR "
               "(a.model = 'moving_average' AND a.regime = 'fine_tune' AND b.model = 'moving_average' "
               "AND b.regime = 'zero_shot') OR "
               "(a.model = 'moving_average' AND a.regime = 'fine_tune' AND b.model = 'seasonal_naive')) "
               "AND a.metric = 'cost_per_unit'")
    q["planned_contrasts"] = _w(f"{ER},\n{bootstrap('cellps')},\n{pair_tests(pair_filter=planned)}",
        """SELECT dataset, model_a || ' ' || regime_a AS label_a, model_b || ' ' || regime_b AS label_b,
    round(a, 6) AS cost_a, round(b, 6) AS cost_b, round(diff, 6) AS diff,
    CASE WHEN p_value < 0.001 THEN '<0.001' ELSE printf('%.3f', p_value) END AS p FROM bs_res""")
    q["rank_disagreement"] = _w(f"""{ER},
{config_cells('', 'brand_region')},
cs AS (SELECT dataset, model, regime, avg(mase) AS MASE, sum(cost) / sum(demand) AS cpu FROM cfgps
  GROUP BY dataset, model, regime),
rk AS (SELECT dataset, model, regime,
    CAST(rank() OVER (PARTITION BY dataset ORDER BY MASE) AS INTEGER) AS mase_rank,
    CAST(rank() OVER (PARTITION BY dataset ORDER BY cpu) AS INTEGER) AS cost_rank FROM cs)""",
        "SELECT dataset, model, regime, mase_rank, cost_rank FROM rk WHERE mase_rank <> cost_rank")
    q["grid_edge"] = _w(ER, f"""SELECT 'moving_average' AS model, CAST(k AS INTEGER) AS window,
    (k = {min(WINDOWS)} OR k = {max(WINDOWS)}) AS is_edge FROM best""")
    return q


ORACLE_SQL = build()
