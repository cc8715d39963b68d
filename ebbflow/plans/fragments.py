"""SQL fragments shared by the checking queries: the daily series as common table expressions."""

SHIP = """ship AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS time,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""

STATUS = """status AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS time,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""

SUPP = """supp AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS time,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""

ORDER = """ords AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS time,
  sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""

NATION = """per_nation AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id,
    CAST(o_orderdate AS DATE) AS time, sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nation_days AS (SELECT k.series_id, CAST(d.day AS DATE) AS time
  FROM (SELECT DISTINCT series_id FROM per_nation) k,
       (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS day FROM per_nation) d),
nat AS (SELECT g.series_id, g.time, coalesce(p.value, 0.0) AS value
  FROM nation_days g LEFT JOIN per_nation p USING (series_id, time))"""


def full(source: str, name: str = "fullc") -> str:
    """The series of ``source`` with a row for every day between its first and last one."""
    return f"""{name}_days AS (SELECT series_id,
    CAST(unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS DATE) AS time
  FROM {source} GROUP BY series_id),
{name} AS (SELECT g.series_id, g.time, s.value
  FROM {name}_days g LEFT JOIN {source} s USING (series_id, time))"""


def water_year(time: str = "time", origin: str = "01-01") -> str:
    return f"(year({time}) - CASE WHEN strftime({time}, '%m-%d') < '{origin}' THEN 1 ELSE 0 END)"


def days_in(year: str, origin: str = "01-01") -> str:
    month, day = (int(p) for p in origin.split("-"))
    return (f"date_diff('day', make_date({year}, {month}, {day}), "
            f"make_date({year} + 1, {month}, {day}))")


LEAP = "((year(time) % 4 = 0 AND year(time) % 100 <> 0) OR year(time) % 400 = 0)"


def run_id(state: str, source: str, name: str) -> str:
    """0-based run number of ``state`` per series, as CTE ``name`` (adds ``run``)."""
    return f"""{name}_mark AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
    WHEN ({state}) IS DISTINCT FROM lag({state}) OVER w THEN 1 ELSE 0 END AS _chg
  FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY time)),
{name} AS (SELECT * EXCLUDE (_chg), CAST(sum(_chg) OVER (PARTITION BY series_id ORDER BY time) AS INTEGER) AS run
  FROM {name}_mark)"""


def polynomial(x: str, coefficients) -> str:
    out = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + {float(c)!r}::DOUBLE)"
    return out


def qnorm(p: str) -> str:
    from ebbflow.functions import special as sp

    q = f"({p} - 0.5)"
    c = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0 - {p} END))"
    mid = f"{polynomial(f'{r} - 1.6', sp.QNORM_MIDDLE[0])} / {polynomial(f'{r} - 1.6', sp.QNORM_MIDDLE[1])}"
    far = f"{polynomial(f'{r} - 5.0', sp.QNORM_TAIL[0])} / {polynomial(f'{r} - 5.0', sp.QNORM_TAIL[1])}"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {q} * "
            f"{polynomial(c, sp.QNORM_CENTRE[0])} / {polynomial(c, sp.QNORM_CENTRE[1])} "
            f"ELSE sign({q}) * (CASE WHEN {r} <= 5.0 THEN {mid} ELSE {far} END) END")


def pnorm(x: str) -> str:
    from ebbflow.functions import special as sp

    a = f"abs({x})"
    upper = (f"exp(-{a} * {a} / 2.0) * {polynomial(a, sp.PNORM_RATIO[0])} / "
             f"{polynomial(a, sp.PNORM_RATIO[1])}")
    tail = (f"exp(-{a} * {a} / 2.0) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65)))))"
            f" / sqrt(2.0 * pi())")
    q = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {upper} ELSE {tail} END)"
    return f"CASE WHEN {x} > 0 THEN 1.0 - {q} ELSE {q} END"


def t_pvalue(t: str, dof: str) -> str:
    """Two-sided Student-t p-value for whole degrees of freedom from the finite cosine series."""
    theta = f"atan({t} / sqrt({dof}))"
    odd = (f"(2.0 / pi()) * (abs({theta}) + abs(sin({theta})) * coalesce(list_sum(list_transform("
           f"range(0, CAST(({dof} - 1) / 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) "
           f"* sqrt(pi()) / 2.0 * pow(cos({theta}), 2 * k + 1))), 0.0))")
    even = (f"abs(sin({theta})) * list_sum(list_transform(range(0, CAST({dof} / 2 AS BIGINT)), "
            f"lambda k: CASE WHEN k = 0 THEN 1.0 ELSE exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) "
            f"* pow(cos({theta}), 2 * k) END))")
    return f"(1.0 - CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
