"""SQL twins of the registered queries, put together from a few parts."""

from __future__ import annotations

from folioframe.sources import demo_panel

D = 8  # digits that results are rounded to


def r(x: str, name: str) -> str:
    return f"round({x}, {D}) + 0.0 AS {name}"


def fractions(n: int) -> str:
    return "[" + ", ".join(repr(i / n) for i in range(1, n)) + "]"


def bins(x: str) -> str:
    return f"CAST(1 + len(list_filter(e, lambda q: q < {x})) AS INTEGER)"


def momentum(window: int, skip: int, ret: str = "ret", name: str = "signal") -> str:
    """Two common table expressions: panel ``f`` to panel ``prep`` with the signal."""
    frame = f'OVER (PARTITION BY "ID" ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)'
    log = f"CASE WHEN {ret} > -1 THEN ln(1 + {ret}) END"
    return f"""
    mom AS (SELECT *, CASE WHEN count({log}) {frame} = {window} THEN exp(sum({log}) {frame}) - 1 END AS _s FROM f),
    prep AS (SELECT *, lag(_s, {skip}) OVER (PARTITION BY "ID" ORDER BY date) AS {name} FROM mom)"""


def reversal(window: int, skip: int, ret: str = "ret", name: str = "signal") -> str:
    def full(k: int) -> str:
        frame = f'OVER (PARTITION BY "ID" ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)'
        return f"CASE WHEN count({ret}) {frame} = {k} THEN sum({ret}) {frame} END"

    return f"prep AS (SELECT *, {full(window)} - {full(skip)} AS {name} FROM f)"


def filtered(adj: str, level: float | tuple[float, float], location: str | None = None, threshold: float = 25.0) -> tuple[str, str]:
    """Panel ``panel`` to ``f`` with ret_adj and ret_adj_ep; and the condition that matches the universe."""
    watched = {"trim": "ret", "price": '"PRICE"', "bounce": "bounce"}.get(adj, "ret")
    base = 'b0 AS (SELECT *, ret * lag(ret) OVER (PARTITION BY "ID" ORDER BY date) AS bounce FROM panel)'
    if adj != "wins":
        if isinstance(level, tuple):
            out, ok = f"{watched} > {level[1]} OR {watched} < {level[0]}", f"{watched} BETWEEN {level[0]} AND {level[1]}"
        else:
            high = level >= threshold if adj == "price" else level >= 0
            out = f"{watched} {'>' if high else '<'} {level}"
            high = level > threshold if adj == "price" else level >= 0
            ok = f"{watched} {'<=' if high else '>='} {level}" if level else "true"
        kept = f"CASE WHEN coalesce({out}, false) THEN NULL ELSE ret END"
        return f"{base}, f AS (SELECT *, {kept} AS ret_adj, {kept} AS ret_adj_ep, ret IS NOT NULL AND coalesce({out}, false) AS out FROM b0)", ok
    lo, hi = (100 - level) / 100, level / 100

    def clip(a: str, b: str) -> str:
        x = "ret"
        if location in ("right", "both"):
            x = f"CASE WHEN ret > {b} THEN {b} ELSE {x} END"
        if location in ("left", "both"):
            x = f"CASE WHEN ret < {a} THEN {a} ELSE {x} END"
        return f"CASE WHEN ret IS NOT NULL THEN {x} END"

    at = {"right": "ret_adj_ep = hi_ep", "left": "ret_adj_ep = lo_ep", "both": "ret_adj_ep = lo_ep OR ret_adj_ep = hi_ep"}[location]
    return (
        f"""{base}, ds AS (SELECT DISTINCT date FROM panel),
        th AS (SELECT ds.date, quantile_cont(p.ret, {lo!r}) AS lo, quantile_cont(p.ret, {hi!r}) AS hi
               FROM ds JOIN panel p ON p.date < ds.date GROUP BY ds.date),
        al AS (SELECT quantile_cont(ret, {lo!r}) AS lo_ep, quantile_cont(ret, {hi!r}) AS hi_ep FROM panel),
        f0 AS (SELECT b0.*, lo, hi, lo_ep, hi_ep, {clip("lo", "hi")} AS ret_adj, {clip("lo_ep", "hi_ep")} AS ret_adj_ep
               FROM b0 LEFT JOIN th USING (date) CROSS JOIN al),
        f AS (SELECT *, coalesce({at}, false) AS out FROM f0)""",
        "true",
    )


def sort(
    kind: str,
    signal: str,
    n: int,
    K: int = 1,
    *,
    f: str = "f AS (SELECT * FROM panel)",
    prep: str = "prep AS (SELECT * FROM f)",
    match: str = "true",
    rating: str = "true",
    dynamic: bool = False,
    signal2: str | None = None,
    n2: int | None = None,
    how: str = "unconditional",
    ep: bool = False,
    chars: tuple[str, ...] = (),
) -> str:
    """Common table expressions up to ``mem`` (members), ``coh`` (cohort returns) and ``res`` (date, regime, ptf, ew, vw)."""
    more = f", {signal2} AS signal2" if signal2 else ""
    present = f"{signal} IS NOT NULL" + (f" AND {signal2} IS NOT NULL" if signal2 else "")
    regimes = [("ea", "ret")] + ([("ep", "ret_adj_ep")] if ep else [])
    weight = "b.VW" if dynamic else "s.VW"
    need = " AND b.VW IS NOT NULL" if dynamic else ""
    held = " UNION ALL ".join(
        f"""SELECT s."ID", s.t, h.h, CAST(s.t % {K} AS INTEGER) AS cohort, s.b1{', s.signal2' if signal2 else ''}, '{g}' AS regime,
               a.{col} AS r, a.ret, {weight} AS w, b.VW AS base{''.join(f', b.{c}' for c in chars)}
        FROM s1 s CROSS JOIN (SELECT unnest(range(1, {K + 1})) AS h) h
        JOIN prep a ON a."ID" = s."ID" AND a.t = s.t + h.h AND a.{col} IS NOT NULL
        LEFT JOIN prep b ON b."ID" = s."ID" AND b.t = s.t + h.h - 1
        WHERE true{need}"""
        for g, col in regimes
    )
    if not signal2:
        ranked = "mem AS (SELECT *, b1 AS ptf FROM held)"
    elif how == "unconditional":
        ranked = f"""e2 AS (SELECT t, h, regime, quantile_cont(signal2, {fractions(n2)}) AS e FROM held GROUP BY t, h, regime),
        mem AS (SELECT held.*, (b1 - 1) * {n2} + {bins('signal2')} AS ptf FROM held JOIN e2 USING (t, h, regime))"""
    else:
        ranked = f"""e2 AS (SELECT t, h, regime, b1, quantile_cont(signal2, {fractions(n2)}) AS e FROM held GROUP BY t, h, regime, b1),
        h2 AS (SELECT held.*, {bins('signal2')} AS b2 FROM held JOIN e2 USING (t, h, regime, b1)),
        mem AS (SELECT *, (b1 - 1) * max(b2) OVER (PARTITION BY t, h, regime, b1) + b2 AS ptf FROM h2)"""
    return f"""{demo_panel.sql(kind)}, {f}, {prep},
    elig AS (SELECT *, {signal} AS x{more} FROM prep
             WHERE {present} AND {rating} AND coalesce({match}, false) AND t < (SELECT max(t) + 1 FROM panel) - {K}),
    e1 AS (SELECT t, quantile_cont(x, {fractions(n)}) AS e FROM elig GROUP BY t),
    s1 AS (SELECT elig.*, {bins('x')} AS b1 FROM elig JOIN e1 USING (t)),
    held AS ({held}), {ranked},
    {returns(K)}"""


def returns(K: int, members: str = "mem") -> str:
    return f"""coh AS (SELECT regime, t, h, ptf, avg(r) AS ew, coalesce(sum(r * w) / nullif(sum(w), 0), 0.0) AS vw
            FROM {members} GROUP BY regime, t, h, ptf),
    res0 AS (SELECT t + h AS t, regime, ptf, CASE WHEN count(ew) = {K} THEN avg(ew) END AS ew, CASE WHEN count(vw) = {K} THEN avg(vw) END AS vw
             FROM coh GROUP BY 1, 2, 3),
    cal AS (SELECT DISTINCT date, t FROM panel),
    res AS (SELECT date, regime, ptf, ew, vw FROM res0 JOIN cal USING (t))"""


def portfolios(ctes: str) -> str:
    return f"WITH {ctes} SELECT date, regime, CAST(ptf AS INTEGER) AS ptf, {r('ew', 'ew')}, {r('vw', 'vw')} FROM res"


def ls(n: int, n2: int | None = None) -> str:
    """Common table expression ``ls`` (date, regime, ew, vw) from ``res``."""
    if n2 is None:
        long, short, rows = f"ptf = {n}", "ptf = 1", 1
    else:
        long, short, rows = f"(ptf - 1) % {n2} = {n2 - 1}", f"(ptf - 1) % {n2} = 0", n

    def total(c: str) -> str:
        return f"CASE WHEN count({c}) = {2 * rows} THEN sum(CASE WHEN {long} THEN {c} ELSE -{c} END) / {rows} END AS {c}"

    return f"ls AS (SELECT date, regime, {total('ew')}, {total('vw')} FROM res WHERE {long} OR {short} GROUP BY date, regime)"


def long_short(ctes: str, n: int, n2: int | None = None) -> str:
    return f"WITH {ctes}, {ls(n, n2)} SELECT date, regime, {r('ew', 'ew')}, {r('vw', 'vw')} FROM ls"


def turnover(K: int, members: str = "mem") -> str:
    """Common table expression ``turn`` from ``members`` and ``cal``."""

    def whole(c: str, agg: str) -> str:
        return f"CASE WHEN count({c}) = count(*) THEN {agg} END AS {c}"

    return f"""wt AS (SELECT regime, t + h - 1 AS s, cohort, ptf, "ID", 1.0::DOUBLE / count(*) OVER g AS ew, w / sum(w) OVER g AS vw,
                     (1 + ret) / (1 + avg(r) OVER g) AS drift FROM {members} WINDOW g AS (PARTITION BY regime, t, h, ptf)),
    sg AS (SELECT regime, s, cohort, ptf, "ID", ew, vw FROM wt WHERE s >= 1
           UNION ALL SELECT regime, s + 1, cohort, ptf, "ID", -drift * ew, -drift * vw FROM wt),
    mv AS (SELECT regime, s, cohort, ptf, "ID", {whole('ew', 'abs(sum(ew))')}, {whole('vw', 'abs(sum(vw))')} FROM sg GROUP BY ALL),
    mc AS (SELECT regime, s, cohort, ptf, {whole('ew', 'nullif(sum(ew), 0)')}, {whole('vw', 'nullif(sum(vw), 0)')} FROM mv GROUP BY ALL),
    turn AS (SELECT date, regime, ptf, ew, vw FROM (
        SELECT s AS t, regime, ptf, CASE WHEN count(ew) = {K} THEN avg(ew) END AS ew, CASE WHEN count(vw) = {K} THEN avg(vw) END AS vw
        FROM mc GROUP BY s, regime, ptf) JOIN cal USING (t))"""


def chars(names: tuple[str, ...], K: int) -> str:
    """Common table expression ``ch`` from ``mem`` and ``cal``."""
    each = " UNION ALL ".join(f"SELECT regime, t, h, ptf, '{c}' AS char, {c} AS x, base, w / sum(w) OVER (PARTITION BY regime, t, h, ptf) AS share FROM mem" for c in names)
    return f"""cl AS (SELECT * FROM ({each}) WHERE base IS NOT NULL),
    c1 AS (SELECT regime, t, h, ptf, char, avg(x) AS ew, coalesce(sum(x * share), 0.0) AS vw FROM cl GROUP BY ALL),
    ch AS (SELECT date, regime, ptf, char, ew, vw FROM (
        SELECT t + h AS t, regime, ptf, char, CASE WHEN count(ew) = {K} THEN avg(ew) END AS ew, CASE WHEN count(vw) = {K} THEN avg(vw) END AS vw
        FROM c1 GROUP BY 1, 2, 3, 4) JOIN cal USING (t))"""


def banded(n: int, width: int, K: int) -> str:
    """Common table expression ``band`` from ``mem``: the recursion itself, step by step."""
    return f"""turns AS (SELECT t, CAST(row_number() OVER (PARTITION BY t % {K} ORDER BY t) - 1 AS INTEGER) AS nth FROM (SELECT DISTINCT t FROM elig)),
    st AS (SELECT mem.*, CAST(nth * {K} + h - 1 AS INTEGER) AS step FROM mem JOIN turns USING (t)),
    rec AS (SELECT cohort, "ID", step, ptf FROM st WHERE step = 0
            UNION ALL
            SELECT st.cohort, st."ID", st.step,
                   CASE WHEN prev.ptf = {n} AND st.ptf >= {n - width} THEN {n} WHEN prev.ptf = 1 AND st.ptf <= {1 + width} THEN 1 ELSE st.ptf END
            FROM (SELECT cohort, step + 1 AS step FROM rec GROUP BY cohort, step) nx
            JOIN st ON st.cohort = nx.cohort AND st.step = nx.step
            LEFT JOIN rec prev ON prev.cohort = st.cohort AND prev."ID" = st."ID" AND prev.step = st.step - 1),
    band AS (SELECT st.* EXCLUDE (ptf), rec.ptf FROM st JOIN rec USING (cohort, "ID", step))"""


def hac(by: str, lag: int, src: str = "series", value: str = "value") -> str:
    """Common table expression ``hac`` (by, n, mean, se, t) of series in ``src``."""
    lags = "".join(
        f", e * lag(e, {k}) OVER (PARTITION BY {by} ORDER BY date) AS g{k}" for k in range(1, lag + 1)
    )
    spread = "sum(e * e)" + "".join(f" + {2 * (1 - k / (lag + 1))!r} * coalesce(sum(g{k}), 0.0)" for k in range(1, lag + 1))
    return f"""dm AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {by}) AS e FROM {src} WHERE {value} IS NOT NULL),
    gs AS (SELECT *{lags} FROM dm),
    hac AS (SELECT *, mean / nullif(se, 0) AS t FROM (
        SELECT {by}, count(*) AS n, avg({value}) AS mean, sqrt({spread}) / count(*) AS se FROM gs GROUP BY {by}))"""


def normal_p(t: str) -> str:
    """Two-sided normal tail of ``t``: one less twice the density times the series z^(2k+1) / (2k+1)!!."""
    z = f"abs({t})"
    term = f"exp((2 * k + 1) * ln({z}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    tail = f"greatest(1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: {term})), 0)"
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0 WHEN {z} > 8 THEN 0.0 ELSE {tail} END"


def student_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t at whole degrees of freedom, by the finite sums over powers of the cosine."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1) + 2 * k * ln(cos({angle})))"
    odd = f"exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + 2 * k * ln(cos({angle})))"
    total = lambda n, term: f"coalesce(list_sum(list_transform(range(0, {n}), lambda k: {term})), 0)"
    inside = f"""CASE WHEN {df} % 2 = 0 THEN sin({angle}) * {total(f'{df} // 2', even)}
        ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {total(f'greatest(({df} - 1) // 2, 0)', odd)}) END"""
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0 ELSE greatest(1 - ({inside}), 0) END"


def alpha(by: str, lag: int, src: str = "j") -> str:
    """Common table expression ``al`` (by, alpha, alpha_t) of y on x1 and x2 in ``src`` (by, date, y, x1, x2): normal
    equations solved by cofactors, and the Newey-West variance of the constant from its influence ``u`` of each date."""
    lags = "".join(f", u * lag(u, {k}) OVER (PARTITION BY {by} ORDER BY date) AS g{k}" for k in range(1, lag + 1))
    spread = "sum(u * u)" + "".join(f" + {2 * (1 - k / (lag + 1))!r} * coalesce(sum(g{k}), 0.0)" for k in range(1, lag + 1))
    return f"""jx AS (SELECT * FROM {src} WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
    m1 AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS a, sum(x2) AS b, sum(x1 * x1) AS aa, sum(x1 * x2) AS ab, sum(x2 * x2) AS bb,
                  sum(y) AS y0, sum(x1 * y) AS y1, sum(x2 * y) AS y2 FROM jx GROUP BY {by}),
    m2 AS (SELECT *, aa * bb - ab * ab AS c00, ab * b - a * bb AS c01, a * ab - aa * b AS c02, n * bb - b * b AS c11, a * b - n * ab AS c12, n * aa - a * a AS c22 FROM m1),
    m3 AS (SELECT *, n * c00 + a * c01 + b * c02 AS det FROM m2),
    m4 AS (SELECT *, (c00 * y0 + c01 * y1 + c02 * y2) / det AS b0, (c01 * y0 + c11 * y1 + c12 * y2) / det AS b1, (c02 * y0 + c12 * y1 + c22 * y2) / det AS b2 FROM m3),
    u0 AS (SELECT {by}, date, b0, (y - b0 - b1 * x1 - b2 * x2) * (c00 + c01 * x1 + c02 * x2) / det AS u FROM jx JOIN m4 USING ({by})),
    u1 AS (SELECT *{lags} FROM u0),
    al AS (SELECT {by}, max(b0) AS alpha, max(b0) / sqrt({spread}) AS alpha_t FROM u1 GROUP BY {by})"""
