"""The same answers in SQL for an independent engine, written from the definitions.

Folds here come from row numbers, medians from the engine's own median, and
models from closed formulas, none of which the Spark side uses.
"""

from __future__ import annotations

from driftline.functions.columns import NA_TOKENS
from driftline.operators.importance import ROUNDS, swapped
from driftline.operators.linear import RIDGE_ALPHAS
from driftline.operators.splits import MOST_BINS
from driftline.plans.queries import CONFIG, DAILY_STEP, MANY_FOLDS, RIDGE_TWO_ALPHA, STUMPS
from driftline.operators.estimators import NO_MODEL
from driftline.sources.export import BAD_NUMBER, BAD_TIME, INCOMPLETE, SURPLUS
from driftline.sources.views import SURPLUS_AH, EVENT_TYPES, LINE_STATUS, RETURN_FLAGS, SENSOR_WEIGHTS, VIEW_SPEC
from driftline.operators.timesplit import TOO_FEW_FOR_BLOCKS, TOO_FEW_FOR_FOLDS

SENSORS, FEATURES = VIEW_SPEC.sensors, VIEW_SPEC.continuous
ISO = "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') " \
      "ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"


def iso(column: str) -> str:
    return ISO.format(column)


def r(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0::DOUBLE"


def rmse(y: str, p: str) -> str:
    return f"sqrt(avg(({y} - {p}) * ({y} - {p})))"


def measures(y: str, p: str) -> str:
    square = f"({y} - {p}) * ({y} - {p})"
    return (
        f"{r(f'sqrt(avg({square}))')} AS rmse, {r(f'avg(abs({y} - {p}))')} AS mae, "
        f"CASE WHEN min({y}) <> max({y}) THEN {r(f'1.0 - sum({square}) / (var_pop({y}) * count({y}))')} END AS r2"
    )


def _exact_mean(value: str, where: str | None = None) -> str:
    number = f"CAST({value} AS DECIMAL(18,4))"
    chosen = number if where is None else f"CASE WHEN {where} THEN {number} END"
    return f"CAST(sum({chosen}) AS DOUBLE) / count({chosen})"


def _with_outages(means: str, stand_in: float, noise: str, in_check: str, in_maintenance: str) -> str:
    mix = "2.0::DOUBLE" + "".join(
        f" + {w}::DOUBLE * coalesce(s{i}, {stand_in}::DOUBLE)" for i, w in enumerate(SENSOR_WEIGHTS, 1)
    )
    sensors = ", ".join(f"CASE WHEN NOT ({in_maintenance}) THEN {s} END AS {s}" for s in SENSORS)
    return (
        f"means AS ({means}), rows_ AS (SELECT device_id, ts, CASE WHEN NOT ({in_check}) THEN {mix} + {noise} END "
        f"AS reference, {sensors}, w1, w2, w3 FROM means)"
    )


def _events(device: str) -> str:
    sensors = ", ".join(f"{_exact_mean('value', f"event_type = '{kind}'")} AS s{i}" for i, kind in enumerate(EVENT_TYPES, 1))
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
    means = (
        f"SELECT {device} AS device_id, date_trunc('hour', ts) AS ts, {sensors}, {_exact_mean(k)} AS w1, "
        f"CAST(count(*) AS DOUBLE) AS w2, max(value) AS w3 FROM events GROUP BY 1, 2"
    )
    return _with_outages(
        means, 50.0, "0.02::DOUBLE * w1 + 0.1::DOUBLE * sqrt(w3)", "hour(ts) = day(ts) - 1", "hour(ts) = (day(ts) + 11) % 24"
    )


HOURLY = _events("'station'")
FLEET_USER = _events("user_id")
FLEET_SUPPLIER = _with_outages(
    "SELECT l_suppkey AS device_id, l_shipdate AS ts, "
    + ", ".join(f"{_exact_mean('l_quantity', f"l_returnflag = '{f}'")} AS s{i}" for i, f in enumerate(RETURN_FLAGS, 1))
    + ", "
    + ", ".join(f"{_exact_mean('l_quantity', f"l_linestatus = '{f}'")} AS s{i}" for i, f in enumerate(LINE_STATUS, 4))
    + f", {_exact_mean('l_discount')} AS w1, {_exact_mean('l_tax')} AS w2, {_exact_mean('l_extendedprice')} AS w3 "
    "FROM lineitem GROUP BY 1, 2",
    25.0, "0.00002::DOUBLE * w3", "day(ts) = month(ts)", "day(ts) = month(ts) + 13",
)

ANY_SENSOR = f"coalesce({', '.join(SENSORS)}) IS NOT NULL"
PREPARED = (
    "features AS (SELECT *, reference AS y, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week FROM rows_ "
    f"WHERE reference IS NOT NULL AND {ANY_SENSOR})"
)


def cells(k: int = CONFIG.cv_splits) -> str:
    """Row numbers, block sizes, blocks and cells."""
    return f"""{PREPARED},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts) - 1 AS rn,
        count(*) OVER (PARTITION BY device_id) AS n FROM features),
    sized AS (SELECT *, CAST(round_even(n * {CONFIG.train_frac}::DOUBLE, 0) AS BIGINT) AS n_train,
        CAST(round_even(n * {CONFIG.val_frac}::DOUBLE, 0) AS BIGINT) AS n_val FROM numbered),
    folded AS (SELECT *, n_train + n_val AS n_fit, n - n_train - n_val AS n_test, n_train // {k + 1} AS t_train,
        (n_train + n_val) // {k + 1} AS t_final FROM sized),
    cells AS (SELECT * EXCLUDE (reference),
        CASE WHEN rn >= n_fit THEN 'test' WHEN rn >= n_train THEN 'validation' ELSE 'train' END AS block,
        CASE WHEN rn >= n_fit THEN {k + 2} WHEN rn >= n_train THEN {k + 1}
             WHEN rn < n_train - {k} * t_train THEN 0 ELSE (rn - (n_train - {k} * t_train)) // t_train + 1 END AS cell_train,
        CASE WHEN rn >= n_fit THEN {k + 1}
             WHEN rn < n_fit - {k} * t_final THEN 0 ELSE (rn - (n_fit - {k} * t_final)) // t_final + 1 END AS cell_final
        FROM folded)"""


def prefixes(k: int = CONFIG.cv_splits) -> str:
    """Each row once per prefix it belongs to: (scheme, f) for rows in cells before f."""
    return f"""past AS (
        SELECT c.*, 'train' AS scheme, f FROM cells c JOIN range(1, {k + 2}) fs(f) ON c.cell_train < f
        UNION ALL SELECT c.*, 'final' AS scheme, f FROM cells c JOIN range(1, {k + 2}) fs(f) ON c.cell_final < f),
    ahead AS (
        SELECT c.*, 'train' AS scheme, cell_train AS f FROM cells c WHERE cell_train BETWEEN 1 AND {k + 1}
        UNION ALL SELECT c.*, 'final' AS scheme, cell_final AS f FROM cells c WHERE cell_final BETWEEN 1 AND {k + 1})"""


MEDIANS = "medians AS (SELECT device_id, scheme, f, " + ", ".join(
    f"coalesce(median({c}), 0.0::DOUBLE) AS m_{c}" for c in FEATURES
) + " FROM past GROUP BY ALL)"

# One-sensor line per prefix: (device_id, scheme, f, n, mean_y, slope, icept, m).
LINES = """lines AS (
    SELECT device_id, scheme, f, count(*) AS n, avg(y) AS mean_y, any_value(m_s1) AS m,
        CASE WHEN min(x) = max(x) THEN 0.0 ELSE covar_pop(y, x) / var_pop(x) END AS slope,
        avg(y) - CASE WHEN min(x) = max(x) THEN 0.0 ELSE covar_pop(y, x) / var_pop(x) END * avg(x) AS icept
    FROM (SELECT p.*, m_s1, coalesce(s1, m_s1) AS x FROM past p JOIN medians USING (device_id, scheme, f)) GROUP BY ALL)"""

PREDICTED = """predicted AS (SELECT a.device_id, a.ts, a.scheme, a.f, a.y, l.mean_y AS p0,
    l.icept + l.slope * coalesce(a.s1, l.m) AS p1 FROM ahead a JOIN lines l USING (device_id, scheme, f))"""


def _linear(view: str, k: int = CONFIG.cv_splits) -> str:
    return f"WITH {view}, {cells(k)}, {prefixes(k)}, {MEDIANS}, {LINES}, {PREDICTED}"


def _scores(view: str, by: str = "device_id") -> str:
    last = CONFIG.cv_splits + 1
    stage = "CASE scheme WHEN 'train' THEN 'validation' ELSE 'test' END AS stage"
    parts = " UNION ALL ".join(
        f"SELECT {by}, '{name}' AS model, {stage}, count(*) AS n_rows, {measures('y', p)} "
        f"FROM predicted WHERE f = {last} GROUP BY {by}, scheme"
        for name, p in (("mean_baseline", "p0"), ("single_sensor_linear", "p1"))
    )
    return f"{_linear(view)}, scores AS ({parts})"


def _text() -> str:
    """The export text, its fields and its parsed rows."""
    value = "replace(CAST(value AS VARCHAR), '.', ',')"
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
    fields = [
        "CASE WHEN k = 17 THEN '31/02/2024' ELSE strftime(ts, '%d/%m/%Y') END",
        "CASE WHEN k = 7 THEN '' ELSE strftime(ts, '%H.%M.%S') END",
        f"CASE WHEN k = 5 THEN '' WHEN k = 3 THEN 'NA' ELSE {value} END",
        f"CASE WHEN event_type = 'error' THEN '-200' WHEN k = 11 THEN 'abc' ELSE {value} END",
        "'-200'", value, f"CASE WHEN event_type = 'view' THEN '-200' ELSE {value} END", "CAST(k AS VARCHAR)",
        f"CASE WHEN event_type = 'click' THEN '' ELSE {value} END", "CAST(k AS VARCHAR)", value, value,
        f"'-' || {value}", "'-200,0'", "replace(CAST(CAST(k AS DOUBLE) AS VARCHAR), '.', ',')", "''", "''",
    ]
    line = " || ';' || ".join(f"({f})" for f in fields)
    return (
        f"numbered_events AS (SELECT *, {k} AS k FROM events), "
        f"text_ AS (SELECT user_id AS device_id, CASE WHEN k = 13 THEN repeat(';', 16) ELSE {line} END AS line "
        "FROM numbered_events)"
    )


EXPORT_NAMES = ("co", "s1", "nmhc", "c6h6", "s2", "nox", "s3", "no2", "s4", "s5", "t", "rh", "ah")


def _parsed() -> str:
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    present = lambda i: f"CASE WHEN trim(p[{i}]) NOT IN ('', {tokens}) THEN trim(p[{i}]) END"
    number = lambda f: f"TRY_CAST(replace({f}, ',', '.') AS DOUBLE)"
    texts = ", ".join(f"{present(i)} AS t_{n}" for i, n in enumerate(EXPORT_NAMES, 3))
    bad = " OR ".join(f"(t_{n} IS NOT NULL AND {number(f't_{n}')} IS NULL)" for n in EXPORT_NAMES)
    values = ", ".join(f"nullif({number(f't_{n}')}, -200.0::DOUBLE) AS {n}" for n in EXPORT_NAMES)
    return f"""{_text()},
    parts AS (SELECT device_id, string_split(line, ';') AS p FROM text_),
    named AS (SELECT device_id, {present(1)} AS d, {present(2)} AS c, {texts} FROM parts),
    stamped AS (SELECT *, try_strptime(d || ' ' || c, '%d/%m/%Y %H.%M.%S') AS ts FROM named
        WHERE d IS NOT NULL OR c IS NOT NULL),
    judged AS (SELECT *, CASE WHEN d IS NULL OR c IS NULL THEN '{INCOMPLETE}' WHEN ts IS NULL THEN '{BAD_TIME}'
        WHEN {bad} THEN '{BAD_NUMBER}' END AS problem FROM stamped),
    typed AS (SELECT device_id, ts, {values} FROM judged WHERE problem IS NULL)"""


def _accounting(by: str, target: str, sensors: tuple[str, ...], source: str) -> str:
    any_sensor = f"coalesce({', '.join(sensors)})"
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}count(*) AS rows_parsed, count(*) FILTER ({target} IS NULL) AS rows_missing_target, "
        f"count(*) FILTER ({target} IS NOT NULL AND {any_sensor} IS NULL) AS rows_without_sensor_data, "
        f"count(*) FILTER ({target} IS NOT NULL AND {any_sensor} IS NOT NULL) AS rows_used FROM {source}{group}"
    )


def _audit(scheme: str) -> str:
    k = CONFIG.cv_splits
    cell = f"cell_{scheme}"
    return f"""WITH {FLEET_USER}, {cells()},
    edges AS (SELECT device_id, f, count(*) FILTER ({cell} < f) AS train_rows, count(*) FILTER ({cell} = f) AS oof_rows,
        count(*) FILTER ({cell} = 0) AS warmup_rows, min(ts) FILTER ({cell} < f) AS a, max(ts) FILTER ({cell} < f) AS b,
        min(ts) FILTER ({cell} = f) AS c, max(ts) FILTER ({cell} = f) AS d
        FROM cells JOIN range(1, {k + 1}) fs(f) ON true GROUP BY device_id, f)
    SELECT device_id, f AS fold, train_rows, oof_rows, warmup_rows, {iso('a')} AS train_start, {iso('b')} AS train_end,
        {iso('c')} AS oof_start, {iso('d')} AS oof_end FROM edges"""


_DETERMINANT = "((gaa + alpha) * (gbb + alpha) - gab * gab)"
RIDGE_WEIGHTS = (
    f"(gay * (gbb + alpha) - gby * gab) / {_DETERMINANT} / sa", f"(gby * (gaa + alpha) - gay * gab) / {_DETERMINANT} / sb",
)


def _ridge_two(view: str | None = None) -> str:
    """Sums for ridge on s1 and w3, imputed and scaled, per prefix; solved by Cramer's rule."""
    return f"""{_linear(view or FLEET_SUPPLIER)},
    pair AS (SELECT p.device_id, p.scheme, p.f, y, coalesce(s1, m_s1) AS a, coalesce(w3, m_w3) AS b
        FROM past p JOIN medians USING (device_id, scheme, f) WHERE p.scheme = 'train'),
    stats AS (SELECT device_id, f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my,
        CASE WHEN min(a) = max(a) THEN 1.0 ELSE stddev_pop(a) END AS sa,
        CASE WHEN min(b) = max(b) THEN 1.0 ELSE stddev_pop(b) END AS sb,
        covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, var_pop(a) AS va, var_pop(b) AS vb
        FROM pair GROUP BY ALL),
    scaled AS (SELECT *, n * va / (sa * sa) AS gaa, n * vb / (sb * sb) AS gbb, n * cab / (sa * sb) AS gab,
        n * cay / sa AS gay, n * cby / sb AS gby FROM stats)"""


def _shuffles(table: str, repeats: int) -> str:
    """CTEs from the rows of ``table`` (device_id, ts) to ``sent``: each (device_id, key, place) with the row whose value comes there."""
    width = len(VIEW_SPEC.features)
    steps, last = [], "keyed"
    for turn in range(ROUNDS):
        steps.append(f"turn_{turn} AS (SELECT * REPLACE ({swapped('x', str(turn), 'key', 'size', CONFIG.seed)} AS x) FROM {last})")
        last = f"turn_{turn}"
    return f"""placed AS (SELECT device_id, ts, row_number() OVER (PARTITION BY device_id ORDER BY
            md5(CAST(device_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ':{CONFIG.seed}'), ts) - 1 AS place,
            count(*) OVER (PARTITION BY device_id) AS size FROM {table}),
    keyed AS (SELECT device_id, ts, size, place AS x, key FROM placed JOIN range(0, {repeats * width}) ks(key) ON true),
    {", ".join(steps)},
    sent AS (SELECT p.device_id, t.key, p.ts, t.ts AS giver FROM {last} t JOIN placed p ON p.device_id = t.device_id AND p.place = t.x)"""


def _increases(tested: str, shares: dict[str, str]) -> str:
    """Importance from rows ``tested`` with y, p and the features' shares of p; features without a share change nothing."""
    width = len(VIEW_SPEC.features)
    own, given = (
        "CASE s.key % " + str(width) + "".join(f" WHEN {VIEW_SPEC.features.index(c)} THEN {t}.{column}" for c, column in shares.items()) + " ELSE 0.0 END"
        for t in ("o", "g")
    )
    return f"""{_shuffles(tested, CONFIG.importance_repeats)},
    errors AS (SELECT s.device_id, s.key, sqrt(avg(pow(o.y - o.p + ({own}) - ({given}), 2))) AS e, sqrt(avg(pow(o.y - o.p, 2))) AS plain
        FROM sent s JOIN {tested} o ON o.device_id = s.device_id AND o.ts = s.ts
        JOIN {tested} g ON g.device_id = s.device_id AND g.ts = s.giver GROUP BY ALL),
    names(position, feature) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(VIEW_SPEC.features))}),
    importance AS (SELECT device_id, feature, CAST(position AS BIGINT) AS position, {r('avg(e - plain)')} AS rmse_increase_mean,
        {r('stddev_pop(e - plain)')} AS rmse_increase_std FROM errors JOIN names ON position = key % {width} GROUP BY ALL)"""


def _importance(view: str) -> str:
    return f"""{_linear(view)},
    tested AS (SELECT a.device_id, a.ts, a.y, l.slope * coalesce(a.s1, l.m) AS share, l.icept + l.slope * coalesce(a.s1, l.m) AS p
        FROM ahead a JOIN lines l USING (device_id, scheme, f) WHERE a.scheme = 'final' AND a.f = {CONFIG.cv_splits + 1}),
    {_increases("tested", {VIEW_SPEC.single_sensor: "share"})}"""


def _importance_three() -> str:
    """A ridge of s1 and w3 plus the daily profile, on the validation block."""
    last = CONFIG.cv_splits + 1
    profile = "(hour(a.ts) - 11.5::DOUBLE) * " + repr(DAILY_STEP) + "::DOUBLE"
    wa = "((gay * (gbb + alpha) - gby * gab) / ((gaa + alpha) * (gbb + alpha) - gab * gab) / sa)"
    wb = "((gby * (gaa + alpha) - gay * gab) / ((gaa + alpha) * (gbb + alpha) - gab * gab) / sb)"
    return f"""{_ridge_two(HOURLY)}, solved AS (SELECT *, {RIDGE_TWO_ALPHA}::DOUBLE AS alpha, {wa} AS wa, {wb} AS wb FROM scaled WHERE f = {last}),
    shares AS (SELECT a.device_id, a.ts, a.y, my - wa * ma - wb * mb AS icept, wa * coalesce(a.s1, m_s1) AS sa1, wb * coalesce(a.w3, m_w3) AS sw3,
        {profile} AS shour FROM ahead a JOIN solved s ON a.device_id = s.device_id AND a.f = s.f
        JOIN medians m ON m.device_id = s.device_id AND m.f = s.f AND m.scheme = 'train' WHERE a.scheme = 'train' AND a.f = {last}),
    tested AS (SELECT *, icept + sa1 + sw3 + shour AS p FROM shares),
    {_increases("tested", {"s1": "sa1", "w3": "sw3", "hour": "shour"})}"""


def _stumps() -> str:
    """Boosted trees of one split: edges at exact quantiles, the split with the largest fall of the penalised error, added to what was predicted."""
    last, width, rate, l2, least = CONFIG.cv_splits + 1, len(VIEW_SPEC.features), *(STUMPS[k] for k in ("learning_rate", "l2_regularization", "min_samples_leaf"))
    values = "[" + ", ".join([f"coalesce({c}, m_{c})" for c in FEATURES] + ["CAST(hour AS DOUBLE)", "CAST(day_of_week AS DOUBLE)"]) + "]"
    rows = "SELECT {0}.device_id, {0}.ts, y, " + values + " AS v FROM {0} JOIN medians USING (device_id, scheme, f) WHERE scheme = 'train' AND f = " + str(last)
    steps = []
    for turn in range(STUMPS["max_iter"]):
        steps.append(f"""sides_{turn} AS (SELECT i, edge, count(*) AS n, sum(y - p) AS s, count(*) FILTER (v[i + 1] <= edge) AS nl,
        sum(y - p) FILTER (v[i + 1] <= edge) AS sl FROM edges JOIN fit_{turn} ON true GROUP BY i, edge),
    split_{turn} AS (SELECT i, edge, {rate}::DOUBLE * sl / (nl + {l2}) AS a, {rate}::DOUBLE * (s - sl) / (n - nl + {l2}) AS b FROM sides_{turn}
        WHERE nl >= {least} AND n - nl >= {least}
        ORDER BY sl * sl / (nl + {l2}) + (s - sl) * (s - sl) / (n - nl + {l2}) - s * s / (n + {l2}) DESC, i, edge LIMIT 1)""")
        for name in ("fit", "held"):
            steps.append(f"{name}_{turn + 1} AS (SELECT device_id, ts, y, v, p + CASE WHEN v[i + 1] <= edge THEN a ELSE b END AS p FROM {name}_{turn}, split_{turn})")
    return f"""{_linear(HOURLY)},
    inside AS ({rows.format("past")}), beyond AS ({rows.format("ahead")}),
    long AS (SELECT unnest(range(0, {width})) AS i, unnest(v) AS x FROM inside),
    kinds AS (SELECT i, count(DISTINCT x) AS k, count(*) AS n FROM long GROUP BY i),
    sorted AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x) - 1 AS place FROM long),
    few AS (SELECT i, x + (lead(x) OVER (PARTITION BY i ORDER BY x) - x) / 2 AS edge FROM (SELECT DISTINCT i, x FROM long) JOIN kinds USING (i) WHERE k <= {MOST_BINS}),
    cuts AS (SELECT i, (j * (n - 1)) // {MOST_BINS} AS low, (j * (n - 1) + {MOST_BINS - 1}) // {MOST_BINS} AS high
        FROM kinds JOIN range(1, {MOST_BINS}) js(j) ON true WHERE k > {MOST_BINS}),
    edges AS (SELECT i, edge FROM few WHERE edge IS NOT NULL UNION
        SELECT c.i, a.x + (b.x - a.x) / 2 FROM cuts c JOIN sorted a ON a.i = c.i AND a.place = c.low JOIN sorted b ON b.i = c.i AND b.place = c.high),
    fit_0 AS (SELECT *, avg(y) OVER () AS p FROM inside), held_0 AS (SELECT *, (SELECT avg(y) FROM inside) AS p FROM beyond),
    {", ".join(steps)}
    SELECT device_id, 'hist_gradient_boosting' AS model, {r(rmse("y", "p"))} AS rmse, {r("avg(abs(y - p))")} AS mae FROM held_{STUMPS["max_iter"]} GROUP BY device_id"""


def _nonnegative_two(k: int = CONFIG.cv_splits) -> str:
    """Least error among the feasible supports of a two-input blend."""
    flat = "1e-12"
    return f"""{_linear(FLEET_SUPPLIER, k)},
    oof AS (SELECT device_id, avg(y) AS my, avg(p0) AS m0, avg(p1) AS m1, var_pop(y) AS vy, var_pop(p0) AS v0,
        var_pop(p1) AS v1, covar_pop(p0, p1) AS c01, covar_pop(p0, y) AS c0, covar_pop(p1, y) AS c1
        FROM predicted WHERE scheme = 'train' AND f BETWEEN 1 AND {k} GROUP BY device_id),
    tries AS (
        SELECT *, 0 AS size, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM oof
        UNION ALL SELECT *, 1, c0 / v0, 0.0 FROM oof WHERE v0 > {flat} * (v0 + m0 * m0)
        UNION ALL SELECT *, 2, 0.0, c1 / v1 FROM oof WHERE v1 > {flat} * (v1 + m1 * m1)
        UNION ALL SELECT *, 3, (c0 * v1 - c1 * c01) / (v0 * v1 - c01 * c01), (c1 * v0 - c0 * c01) / (v0 * v1 - c01 * c01)
            FROM oof WHERE v0 > {flat} * (v0 + m0 * m0) AND v1 > {flat} * (v1 + m1 * m1)),
    best AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY
            vy - 2 * (w0 * c0 + w1 * c1) + w0 * w0 * v0 + 2 * w0 * w1 * c01 + w1 * w1 * v1, size) AS place
        FROM tries WHERE w0 >= 0 AND w1 >= 0)
    SELECT device_id, {r('my - w0 * m0 - w1 * m1', 5)} AS intercept, {r('w0', 5)} AS weight_mean,
        {r('w1', 5)} AS weight_line FROM best WHERE place = 1"""


def oracle_sql() -> dict[str, str]:
    k, last = CONFIG.cv_splits, CONFIG.cv_splits + 1
    supplier, user, hourly = FLEET_SUPPLIER, FLEET_USER, HOURLY
    stamp = f"{iso('ts')} AS ts"
    values = ", ".join(FEATURES)
    imputed = lambda scheme: ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATURES)
    scaled = ", ".join(
        r(f"(coalesce(x.{c}, m_{c}) - a_{c}) / d_{c}") + f" AS {c}" for c in FEATURES
    )
    stats = ", ".join(
        f"avg(coalesce({c}, m_{c})) AS a_{c}, CASE WHEN stddev_pop(coalesce({c}, m_{c})) = 0 THEN 1.0 "
        f"ELSE stddev_pop(coalesce({c}, m_{c})) END AS d_{c}" for c in FEATURES
    )
    flags = ", ".join(
        [f"CAST(hour = {h} AS BIGINT) AS hour_{h}" for h in range(24)]
        + [f"CAST(day_of_week = {d} AS BIGINT) AS weekday_{d}" for d in range(7)]
    )
    wide = ", ".join(
        f"max({m}) FILTER (stage = '{s}') AS {s}_{m}" for s in ("validation", "test") for m in ("rmse", "mae", "r2")
    )
    alphas = ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(RIDGE_ALPHAS))
    many = MANY_FOLDS.cv_splits
    with_medians = f"{cells()}, {prefixes()}, {MEDIANS}"
    ratio = (
        "CASE WHEN l_tax > 0 THEN l_discount / l_tax WHEN l_discount > 0 THEN 'infinity'::DOUBLE "
        "{0} END"
    )
    wa, wb = RIDGE_WEIGHTS
    return {
        "ingest_parse": f"WITH {_parsed()} SELECT device_id, {stamp}, {', '.join(EXPORT_NAMES)} FROM typed",
        "ingest_reject_counts": f"WITH {_parsed()} SELECT problem, count(*) AS n_rows FROM judged "
                                "WHERE problem IS NOT NULL GROUP BY problem",
        "ingest_files": f"WITH {_parsed()} SELECT CASE WHEN t_ah = '{SURPLUS_AH}' THEN '{SURPLUS}' ELSE coalesce(problem, 'accepted') END "
                        "AS outcome, count(*) AS n_rows FROM judged GROUP BY 1",
        "export_accounting": f"WITH {_parsed()} " + _accounting("device_id", "co", ("s1", "s2", "s3", "s4", "s5"), "typed"),
        "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY 1, 2 "
                          "HAVING count(*) > 1",
        "line_fingerprint": f"WITH {_text()} SELECT device_id, count(*) AS lines, min(sha256(line)) AS least, "
                            "max(sha256(line)) AS greatest FROM text_ GROUP BY device_id",
        "row_accounting_fleet": f"WITH {user} " + _accounting("device_id", "reference", SENSORS, "rows_"),
        "dataset_counts": f"WITH {supplier} " + _accounting("", "reference", SENSORS, "rows_"),
        "prepared_features": f"WITH {supplier}, {PREPARED} SELECT device_id, {stamp}, reference, {values}, hour, "
                             "day_of_week FROM features",
        "calendar_features": f"WITH {hourly} SELECT {stamp}, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week FROM rows_",
        "chrono_split": f"WITH {supplier}, {cells()} SELECT device_id, {stamp}, block FROM cells",
        "block_sizes": f"WITH {user}, {cells()} SELECT DISTINCT device_id, n, n_train, n_val, n_test, "
                       "t_train AS fold_rows_train, t_final AS fold_rows_final FROM cells",
        "block_periods_fleet": f"WITH {user}, {cells()}, ends_ AS (SELECT device_id, block, count(*) AS n_rows, "
                               "min(ts) AS a, max(ts) AS b FROM cells GROUP BY ALL) "
                               f"SELECT device_id, block, n_rows, {iso('a')} AS first_ts, {iso('b')} AS last_ts FROM ends_",
        "fold_assignment": f"WITH {supplier}, {cells()} SELECT device_id, {stamp}, CAST(cell_train AS BIGINT) AS cell_train, "
                           "CAST(cell_final AS BIGINT) AS cell_final FROM cells",
        "fold_assignment_split": f"WITH {supplier}, {cells()} SELECT device_id, {stamp}, "
                                 "CAST(cell_train AS BIGINT) AS cell_train, CAST(cell_final AS BIGINT) AS cell_final FROM cells",
        "fold_audit_train": _audit("train"),
        "fold_audit_final": _audit("final"),
        "rejected_devices": f"""WITH {user}, {PREPARED}, counted AS (SELECT device_id, count(*) AS n FROM features GROUP BY 1),
            sized AS (SELECT *, CAST(round_even(n * {CONFIG.train_frac}::DOUBLE, 0) AS BIGINT) AS a,
                CAST(round_even(n * {CONFIG.val_frac}::DOUBLE, 0) AS BIGINT) AS b FROM counted)
            SELECT device_id, n, CASE WHEN least(a, b, n - a - b) < 1 THEN '{TOO_FEW_FOR_BLOCKS}'
                ELSE '{TOO_FEW_FOR_FOLDS}' END AS reason
            FROM sized WHERE least(a, b, n - a - b) < 1 OR a // {many + 1} < 1""",
        "fold_medians": f"WITH {supplier}, {cells()}, {prefixes()}, " + "long_ AS (" + " UNION ALL ".join(
            f"SELECT device_id, '{c}' AS feature, scheme, f, {c} AS v FROM past" for c in FEATURES
        ) + "), present AS (SELECT DISTINCT device_id, feature FROM long_ WHERE v IS NOT NULL) "
            "SELECT device_id, feature, scheme, f AS cell, median(v) AS median FROM long_ "
            "JOIN present USING (device_id, feature) GROUP BY ALL",
        "median_impute": f"WITH {supplier}, {with_medians} SELECT device_id, {stamp}, {imputed('train')} "
                         f"FROM cells JOIN medians m USING (device_id) WHERE m.scheme = 'train' AND m.f = {last}",
        "standard_scaled": f"WITH {supplier}, {with_medians}, chosen AS (SELECT * FROM medians WHERE scheme = 'train' "
                           f"AND f = {last}), stats AS (SELECT device_id, {stats} FROM cells JOIN chosen USING (device_id) "
                           f"WHERE cell_train < {last} GROUP BY device_id) SELECT x.device_id, {iso('x.ts')} AS ts, {scaled} "
                           "FROM cells x JOIN chosen USING (device_id) JOIN stats USING (device_id)",
        "one_hot_calendar": f"WITH {user}, {PREPARED} SELECT device_id, {stamp}, {flags} FROM features",
        "tree_features": f"WITH {user}, {with_medians} SELECT device_id, {stamp}, {imputed('final')}, "
                         "CAST(hour AS DOUBLE) AS hour, CAST(day_of_week AS DOUBLE) AS day_of_week "
                         f"FROM cells JOIN medians m USING (device_id) WHERE m.scheme = 'final' AND m.f = {last}",
        "mean_models": f"{_linear(supplier)} SELECT device_id, n AS fit_rows, {r('mean_y')} AS mean FROM lines "
                       f"WHERE scheme = 'train' AND f = {last}",
        "fleet_ols": f"{_linear(supplier)} SELECT device_id, scheme, f AS cell, n AS fit_rows, {r('icept')} AS intercept, "
                     f"{r('slope')} AS slope FROM lines",
        "single_sensor_ols": f"{_scores(hourly)} SELECT stage, n_rows, rmse, mae, r2 FROM scores "
                             "WHERE model = 'single_sensor_linear'",
        "ridge_two_feature": f"{_ridge_two()}, solved AS (SELECT *, {RIDGE_TWO_ALPHA}::DOUBLE AS alpha, {wa} AS wa, {wb} AS wb "
                             f"FROM scaled WHERE f = {last}) SELECT device_id, {r('my - wa * ma - wb * mb')} AS intercept, "
                             f"{r('wa', 9)} AS slope_s1, {r('wb', 9)} AS slope_w3 FROM solved",
        "ridge_search_two_feature": f"""{_ridge_two()}, grid(candidate, alpha) AS (VALUES {alphas}),
            solved AS (SELECT *, {wa} AS wa, {wb} AS wb FROM scaled JOIN grid ON true WHERE f <= {k}),
            errors AS (SELECT s.device_id, s.candidate, s.f, {rmse('a.y', '(my + wa * (coalesce(a.s1, m_s1) - ma) + wb * (coalesce(a.w3, m_w3) - mb))')} AS e
                FROM ahead a JOIN solved s ON a.device_id = s.device_id AND a.f = s.f
                JOIN medians m ON m.device_id = s.device_id AND m.f = s.f AND m.scheme = 'train'
                WHERE a.scheme = 'train' GROUP BY ALL)
            SELECT device_id, CAST(candidate AS BIGINT) AS candidate, {r('avg(e)')} AS cv_rmse FROM errors GROUP BY ALL""",
        "later_readings": f"{_linear(supplier)} SELECT device_id, {iso('x.ts')} AS ts, "
                          f"{r('icept + slope * coalesce(s1, m)')} AS prediction FROM rows_ x JOIN lines USING (device_id) "
                          f"WHERE scheme = 'final' AND f = {last} AND reference IS NULL AND {ANY_SENSOR}",
        "unmatched_readings": f"""WITH {user}, {PREPARED}, counted AS (SELECT device_id, count(*) AS n FROM features GROUP BY 1),
            sized AS (SELECT *, CAST(round_even(n * {CONFIG.train_frac}::DOUBLE, 0) AS BIGINT) AS a,
                CAST(round_even(n * {CONFIG.val_frac}::DOUBLE, 0) AS BIGINT) AS b FROM counted),
            judged AS (SELECT *, least(a, b, n - a - b) < 1 OR a // {many + 1} < 1 AS short FROM sized)
            SELECT device_id, CASE WHEN short THEN '{NO_MODEL}' END AS reason, n AS n_rows,
                CASE WHEN short THEN 0 ELSE n END AS n_predicted FROM judged""",
        "stream_scoring": f"WITH {user}, {cells()} SELECT count(*) AS at_once, count(*) AS streamed, 0.0::DOUBLE AS difference "
                          f"FROM rows_ WHERE {ANY_SENSOR} AND device_id IN (SELECT device_id FROM cells)",
        "forward_cv_ols": f"{_linear(supplier)} " + " UNION ALL ".join(
            f"SELECT device_id, {i}::BIGINT AS candidate, CAST(f AS BIGINT) AS fold, count(*) AS n_rows, "
            f"{r(rmse('y', p))} AS rmse FROM predicted WHERE scheme = 'train' AND f <= {k} GROUP BY device_id, f"
            for i, p in enumerate(("p0", "p1"))
        ),
        "oof_prefix_mean": f"{_linear(supplier)} SELECT device_id, {stamp}, CAST(f AS BIGINT) AS fold, {r('p0')} AS prediction "
                           f"FROM predicted WHERE scheme = 'train' AND f <= {k}",
        "stack_two_linear": _nonnegative_two(),
        "stack_two_folds": _nonnegative_two(2),
        "stack_two_folds_split": _nonnegative_two(2),
        "stack_own_final": f"""{_linear(supplier)},
            shifts AS (SELECT device_id, median(y - p1) AS shift FROM predicted WHERE scheme = 'train' AND f BETWEEN 1 AND {k} GROUP BY device_id)
            SELECT device_id, 'stacking' AS model, {r(rmse("y", "(p1 + shift)"))} AS rmse, {r("avg(abs(y - p1 - shift))")} AS mae
            FROM predicted JOIN shifts USING (device_id) WHERE scheme = 'train' AND f = {last} GROUP BY device_id""",
        "score_metrics": f"{_scores(supplier)} SELECT * FROM scores",
        "scores_table": f"{_scores(user)} SELECT device_id, CASE model WHEN 'mean_baseline' THEN 0 ELSE 1 END::BIGINT AS ord, "
                        f"model, {wide} FROM scores GROUP BY device_id, model",
        "metrics_csv": f"{_scores(hourly)} SELECT device_id, model, " + ", ".join(
            f"printf('%.6f', max({m}) FILTER (stage = '{s}')) AS {s}_{m}"
            for s in ("validation", "test") for m in ("rmse", "mae", "r2")
        ) + " FROM scores GROUP BY device_id, model",
        "r2_constant_target": "WITH pairs AS (SELECT CAST(l_linenumber AS BIGINT) AS line_group, CAST(l_linenumber AS DOUBLE) AS y, "
                              "l_quantity AS p FROM lineitem UNION ALL SELECT 0, l_linenumber, l_quantity FROM lineitem) "
                              f"SELECT line_group, count(*) AS n_rows, 0::BIGINT AS unusable, {measures('y', 'p')} "
                              "FROM pairs GROUP BY line_group",
        "unusable_predictions": "WITH pairs AS (SELECT l_suppkey AS device_id, "
                                + ratio.format("WHEN l_returnflag <> 'N' THEN 'nan'::DOUBLE")
                                + " AS p FROM lineitem) SELECT device_id, count(*) AS n_rows, "
                                "count(*) FILTER (p IS NULL OR NOT isfinite(p)) AS unusable FROM pairs GROUP BY device_id",
        "finite_report_values": "WITH pairs AS (SELECT CAST(l_linenumber AS BIGINT) AS line, "
                                + ratio.format("ELSE 'nan'::DOUBLE") + " AS p FROM lineitem) SELECT line, count(*) AS n_rows, "
                                f"count(*) FILTER (isfinite(p)) AS finite_rows, {r('max(p) FILTER (isfinite(p))')} AS largest "
                                "FROM pairs GROUP BY line",
        "select_model": f"{_scores(user)}, placed AS (SELECT *, row_number() OVER (PARTITION BY device_id "
                        "ORDER BY rmse, model) AS place FROM scores WHERE stage = 'validation') "
                        "SELECT device_id, model, rmse FROM placed WHERE place = 1",
        "permutation_importance_ols": f"{_importance(supplier)} SELECT * FROM importance",
        "importance_split": f"{_importance(supplier)} SELECT * FROM importance",
        "boosting_stumps": _stumps(),
        "importance_three_features": f"{_importance_three()} SELECT * FROM importance",
        "importance_three_split": f"{_importance_three()} SELECT * FROM importance",
        "importance_three_general": f"{_importance_three()} SELECT * FROM importance",
        "importance_ranking": f"{_importance(hourly)} SELECT device_id, feature, rmse_increase_mean AS mean, "
                              "row_number() OVER (PARTITION BY device_id ORDER BY rmse_increase_mean DESC, position) AS place "
                              "FROM importance",
    }
