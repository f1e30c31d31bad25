"""The same queries as plain SQL over the driver tables.

The SQL computes every revenue column row by row and scenario by scenario and sums afterwards,
so it checks the engine's order of work, not only its result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from tailrace import schemas
from tailrace.operators.scenarios import Scenario
from tailrace.schemas import plain

# Shared sources -----------------------------------------------------------------------------

FEEDS = """
zones AS (
  SELECT n_nationkey, 'NO' || (n_regionkey + 1) AS zone, r_name AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
shipments AS (
  SELECT CAST(l_shipdate AS DATE) + 9497 AS date, zone, name, l_quantity, l_extendedprice
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN zones ON s_nationkey = n_nationkey),
shipped AS (SELECT date, zone, sum(l_quantity) AS mwh FROM shipments GROUP BY date, zone),
production AS (
  SELECT date, zone, mwh FROM shipped
  UNION ALL SELECT date, 'NO', sum(mwh) FROM shipped GROUP BY date),
sold AS (
  SELECT CAST(o_orderdate AS DATE) + 9497 AS date, zone, sum(l_quantity) AS mwh
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN zones ON c_nationkey = n_nationkey GROUP BY 1, 2),
consumption AS (
  SELECT date, zone, mwh FROM sold UNION ALL SELECT date, 'NO', sum(mwh) FROM sold GROUP BY date),
prices AS (
  SELECT date, name, name || ' (' || zone || ')' AS display_name, lower(zone) AS region,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) / 10 AS value
  FROM shipments GROUP BY date, zone, name)"""

CELLS = """
cells AS (
  SELECT CAST(ts AS DATE) AS day, hour(ts) AS h, event_type,
    lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ' - ' || lpad(CAST(hour(ts) + 1 AS VARCHAR), 2, '0') AS hours,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS all_value,
    CAST(sum(CAST(CASE WHEN user_id % 2 = 0 THEN value END AS DECIMAL(18,2))) AS DOUBLE) AS even_value,
    count(*) AS n
  FROM events GROUP BY ALL),
area(event_type, zone, name, display_name, region) AS (VALUES
  ('click', 'NO1', 'oslo', 'Sørøst-Norge (NO1)', 'no1'),
  ('error', 'NO2', 'kristiansand', 'Sørvest-Norge (NO2)', 'no2'),
  ('purchase', 'NO3', 'trondheim', 'Midt-Norge (NO3)', 'no3'),
  ('signup', 'NO4', 'unmapped', NULL, NULL),
  ('view', 'NO5', 'bergen', 'Vest-Norge (NO5)', 'no5')),
hourly AS (
  SELECT CAST(day AS TIMESTAMP) + to_hours(h) AS date, CAST(day AS VARCHAR) AS day, hours, zone,
    name, display_name, region, all_value, even_value, all_value / n * 4 AS price
  FROM cells JOIN area USING (event_type))"""

HOURLY_FEEDS = (
    CELLS
    + """,
production AS (SELECT date, zone, all_value AS mwh FROM hourly WHERE all_value IS NOT NULL),
consumption AS (SELECT date, zone, even_value AS mwh FROM hourly WHERE even_value IS NOT NULL),
prices AS (SELECT date, name, display_name, region, price AS value FROM hourly)"""
)

STATISTICS = """
statistics AS (
  SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE) + 9497) AS DATE) AS date,
    sum(l_quantity) AS total, sum(l_quantity) FILTER (l_returnflag IN ('A', 'R')) AS hydro
  FROM lineitem GROUP BY 1)"""

RATIOS = """
ratios AS (
  SELECT date, total, hydro, hydro / nullif(total, 0) AS hydro_ratio_month,
    CASE WHEN count(*) OVER w = 4 AND count(hydro) OVER w = 4 AND count(total) OVER w = 4
      THEN avg(hydro) OVER w / nullif(avg(total) OVER w, 0) END AS hydro_ratio_ma4
  FROM statistics WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""

BALANCE = """
long AS (
  SELECT date, lower(zone) AS region, mwh * 1000 AS value, 'pro' AS variable FROM production WHERE zone <> 'NO'
  UNION ALL SELECT date, lower(zone), mwh * 1000, 'cnp' FROM consumption WHERE zone <> 'NO'
  UNION ALL SELECT date, lower(region), value / 100, 'price' FROM prices),
wide AS (
  SELECT date, region, max(value) FILTER (variable = 'pro') AS pro,
    max(value) FILTER (variable = 'cnp') AS cnp, max(value) FILTER (variable = 'price') AS price
  FROM long GROUP BY date, region)"""

SHARED = (
    RATIOS
    + """,
seen AS (
  SELECT wide.*, hydro_ratio_month,
    last_value(hydro_ratio_ma4 IGNORE NULLS) OVER (
      ORDER BY CAST(wide.date AS DATE) NULLS LAST) AS carried
  FROM wide LEFT JOIN ratios ON CAST(wide.date AS DATE) = ratios.date),
shared AS (
  SELECT date, region, pro, cnp, price, coalesce(hydro_ratio_month, carried) AS ssb_prop_vannkraft
  FROM seen)"""
)

TARIFFS = """
    CASE WHEN region = 'no4' THEN 0::DOUBLE ELSE 0.25::DOUBLE END AS param_mva,
    0.70::DOUBLE AS param_stromstotte_floor,
    CASE WHEN date < DATE '2021-12-01' THEN 0::DOUBLE WHEN date < DATE '2022-01-01' THEN 0.55::DOUBLE
      WHEN date < DATE '2022-09-01' THEN 0.8::DOUBLE WHEN date IS NOT NULL THEN 0.9::DOUBLE
      END AS param_stromstotte_prop,
    0.55::DOUBLE AS param_elavgift_prop_alminnelig, 0.16::DOUBLE AS param_elavgift_prop_redusert,
    0.28::DOUBLE AS param_elavgift_prop_fritatt, 0.00546::DOUBLE AS param_elavgift_sats_redusert_normal,
    0.1669::DOUBLE AS param_elavgift_sats_alminnelig_normal, 0.00546::DOUBLE AS param_elavgift_sats_redusert,
    CASE WHEN date < DATE '2021-01-01' THEN NULL WHEN date < DATE '2022-01-01' THEN 0.1669::DOUBLE
      WHEN date < DATE '2022-04-01' THEN 0.0891::DOUBLE WHEN date IS NOT NULL THEN 0.1541::DOUBLE
      END AS param_elavgift_sats_alminnelig"""

PAIR, ALL = ["spot", "normal"], ["spot", "normal", "ekstra"]


def _each(kinds: Sequence[str], name: str, formula: str) -> list[tuple[str, str]]:
    return [(name.format(k=k), formula.format(k=k)) for k in kinds]


def _difference(name: str) -> tuple[str, str]:
    return f"{name}_ekstra", f"{name}_spot - {name}_normal"


REVENUE = [
    ("alt_til_spotpris", "pro * price"),
    (
        "stromstotte_per_kwh",
        "CASE WHEN price_monthly_mean IS NOT NULL THEN"
        " greatest(price_monthly_mean - param_stromstotte_floor, 0) END * param_stromstotte_prop",
    ),
    ("en_vkraft", "pro * ssb_prop_vannkraft * param_prop_spot_eksponert"),
    ("en_inntekt_normert_spot", "en_vkraft * (price - param_skatteposisjon_kr)"),
    ("en_inntekt_normert_normal", "en_vkraft * (param_price_baseline - param_skatteposisjon_kr)"),
    _difference("en_inntekt_normert"),
    *_each(PAIR, "en_inntekt_faktisk_{k}", "en_inntekt_normert_{k} * param_prop_inntekt_faktisk"),
    *_each(PAIR, "en_grunnrenteskatt_{k}", "en_inntekt_normert_{k} * param_skatt_grunnrente"),
    _difference("en_grunnrenteskatt"),
    *_each(PAIR, "en_selskapsskatt_{k}", "en_inntekt_faktisk_{k} * param_skatt_selskap"),
    _difference("en_selskapsskatt"),
    *_each(PAIR, "en_skatt_{k}", "en_selskapsskatt_{k} + en_grunnrenteskatt_{k}"),
    _difference("en_skatt"),
    *_each(PAIR, "en_resultat_til_eiere_{k}", "en_inntekt_faktisk_{k} - en_skatt_{k}"),
    _difference("en_resultat_til_eiere"),
    *[
        pair
        for owner in ("statkraft", "kommfylk", "private")
        for pair in _each(
            ALL,
            f"en_resultat_til_eiere_{{k}}_{owner}",
            f"en_resultat_til_eiere_{{k}} * param_prop_{owner}",
        )
    ],
    ("en_hushold_vkraft", "en_vkraft * param_prop_hushold"),
    ("en_hushold_stromstotte", "en_hushold_vkraft * stromstotte_per_kwh"),
    ("en_hushold_stromstotte_mmva", "en_hushold_stromstotte * (1 + param_mva)"),
    ("en_hushold_kost_spot", "en_hushold_vkraft * price - en_hushold_stromstotte"),
    ("en_hushold_kost_normal", "en_hushold_vkraft * param_price_baseline"),
    _difference("en_hushold_kost"),
    *_each(ALL, "en_hushold_mva_{k}", "en_hushold_kost_{k} * param_mva"),
    *[
        (
            f"en_elavgift{s}",
            f"cnp * param_elavgift_prop_alminnelig * param_elavgift_sats_alminnelig{s}"
            f" + cnp * param_elavgift_prop_redusert * param_elavgift_sats_redusert{s}",
        )
        for s in ("", "_normal")
    ],
    *[
        (
            f"en_staten_{k}",
            f"en_skatt_{k} + en_resultat_til_eiere_{k}_statkraft + en_hushold_mva_{k} + {levy}",
        )
        for k, levy in (("spot", "en_elavgift"), ("normal", "en_elavgift_normal"))
    ],
    _difference("en_staten"),
    ("en_staten_ekstra_etter_stotte", "en_staten_ekstra - en_hushold_stromstotte_mmva"),
]

# Model --------------------------------------------------------------------------------------

RUNNING = [plain(c) for c in schemas.RUNNING]
SUMMED = ["pro", "cnp", *[c for c in map(plain, schemas.MEASURES) if c != "stromstotte_per_kwh"]]
SCENARIO = [plain(c) for c in schemas.SCENARIO]
REGION_ONLY = ["price", "ssb_prop_vannkraft", "price_monthly_mean", "stromstotte_per_kwh", *schemas.TARIFFS]
RESULT = [plain(c) for c in schemas.RESULT]
MINIMAL = [plain(c) for c in schemas.MINIMAL]


def quoted(name: str) -> str:
    return '"group"' if name == "group" else name


def grid(scenarios: Sequence[Scenario]) -> str:
    def literal(value) -> str:
        if value is None:
            return "NULL::VARCHAR"
        if isinstance(value, bool):
            return str(value).upper()
        return f"{value}::DOUBLE" if isinstance(value, float) else f"'{value}'"

    names = [f.name for f in fields(Scenario)]
    rows = [f"({', '.join(literal(getattr(s, n)) for n in names)})" for s in scenarios]
    return f"grid({', '.join(map(quoted, names))}) AS (VALUES {', '.join(rows)})"


def model(
    scenarios: Sequence[Scenario], as_of: str, hourly: bool = False, feeds: str | None = None
) -> str:
    """CTEs up to regional and national results of scenarios with one frequency.

    feeds gives the CTEs production, consumption, prices and statistics; empty text takes them
    from tables of these names.
    """
    feeds = f"{HOURLY_FEEDS if hourly else FEEDS},{STATISTICS}" if feeds is None else feeds
    shared = ",".join(part for part in (feeds, BALANCE, SHARED) if part)
    sums = [f"coalesce(sum({c}), 0) AS {c}" for c in [*SUMMED, *[f"{c}_cum" for c in RUNNING]]]
    cums = [
        f"CASE WHEN count({c}) OVER w = count(*) OVER w THEN sum({c}) OVER w END AS {c}_cum"
        for c in RUNNING
    ]
    scenario = ", ".join(map(quoted, SCENARIO))
    key = ", ".join(f"{quoted(c)}" for c in ["group", *SCENARIO])
    return f"""WITH {shared}, {grid(scenarios)},
names AS (SELECT DISTINCT region, display_name AS region_name FROM prices),
chosen AS (
  SELECT grid.*, shared.* FROM shared JOIN grid ON
    date >= CAST(start_date AS DATE)
    AND date <= coalesce(CAST(end_date AS DATE), DATE '{as_of}' + 1)
    AND (NOT na_rm OR (pro IS NOT NULL AND cnp IS NOT NULL AND price IS NOT NULL))),
priced AS (
  SELECT *, strftime(date, '%Y-%m') AS year_month, CAST(quarter(date) AS INTEGER) AS quarter,
    avg(price) OVER (PARTITION BY "group", region, strftime(date, '%Y-%m')) AS price_monthly_mean,
    {TARIFFS}
  FROM chosen),
revenue AS (SELECT *, {", ".join(f"{text} AS {name}" for name, text in REVENUE)} FROM priced),
named AS (
  SELECT revenue.*, region_name FROM revenue JOIN names
  ON revenue.region IS NOT DISTINCT FROM names.region),
regional AS (
  SELECT *, {", ".join(cums)} FROM named
  WINDOW w AS (PARTITION BY "group", region ORDER BY date, region_name
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
national AS (
  SELECT {key}, date, year_month, quarter, 'no' AS region, 'Norge' AS region_name,
    {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in REGION_ONLY)},
    {", ".join(sums)}
  FROM regional GROUP BY {key}, date, year_month, quarter),
weekly_sums AS (
  SELECT "group", CAST(date_trunc('week', date) AS DATE) AS date,
    {scenario.replace("freq, ", "'weekly' AS freq, ")},
    {", ".join(f"sum({plain(c)}) AS {plain(c)}" for c in schemas.HEADLINE)}
  FROM national GROUP BY ALL),
weekly AS (
  SELECT *, {", ".join(f"sum({plain(c)}) OVER w AS {plain(c)}_cum" for c in schemas.HEADLINE)}
  FROM weekly_sums WINDOW w AS (PARTITION BY "group" ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
minimal AS (
  SELECT {", ".join(map(quoted, MINIMAL))} FROM weekly
  UNION ALL
  SELECT {", ".join(map(quoted, MINIMAL))} FROM national WHERE date >= DATE '{as_of}' - 1)"""


# Rounding -----------------------------------------------------------------------------------

# Sums of doubles differ in their last bits with the order of summation. Columns without the
# hydropower share are multiples of at least 1e-4 and are compared at four digits; columns with
# it at four digits for row values and at zero for large sums. Values may sit on a rounding
# boundary exactly (x.5), so both sides move the boundary by a hundredth of a step.
ON_GRID = {"pro", "cnp", "alt_til_spotpris", "en_elavgift", "en_elavgift_normal"}


def boundary(digits: int) -> float:
    return 0.0123 * 10.0**-digits


def digits(column: str, summed: bool) -> int | None:
    """Rounding of a column; None leaves it as it is."""
    base = column.removesuffix("_cum")
    if column == "price_cum":
        return 6
    if base in ON_GRID:
        return 4
    if base in ("price_monthly_mean", "stromstotte_per_kwh"):
        return 8
    if base in SUMMED:
        return 0 if summed or base != column else 4
    return None


def projection(columns: Sequence[str], summed: bool = False) -> str:
    """Select list with the rounding of the comparison; adding 0 turns -0 into 0."""

    def item(column: str) -> str:
        n = digits(column, summed)
        if n is None:
            return quoted(column)
        return f"round({column} + {boundary(n)!r}::DOUBLE, {n}) + 0 AS {column}"

    return ", ".join(map(item, columns))
