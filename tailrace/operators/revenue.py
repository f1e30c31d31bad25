"""Revenue model, split into a scenario-free and a scenario part.

Every revenue column is a sum of scenario coefficients times scenario-free row values
("terms": hydropower volume, its market value, its support, ...). Sums and running totals of
a revenue column are therefore the same combination of sums and running totals of the terms.
The engine shuffles, sums and orders terms once, and expands scenarios by projection last,
so scenarios multiply neither the rows that move nor the windows.

A column is NULL where one of its inputs is, and sums skip those rows. A "basis" keeps this
exact: the terms are masked once per set of inputs that columns share, and a column uses the
terms of its own set. Basis columns are named '<set>__<term>'. Column families are SQL text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions import pmax

# Scenario-free row values, in dependency order. v is hydropower volume, p its market value,
# s its volume times the support share (per unit of support rate, see rate_support), m marks
# the part that VAT is due on.
TERMS = {
    "alt": "pro * price",
    "v": "pro * ssb_prop_vannkraft",
    "vp": "v * price",
    "vs": "v * param_stromstotte_prop",
    "mv": "v * param_mva",
    "mvp": "vp * param_mva",
    "mvs": "vs * param_mva",
    "levy": "cnp * (param_elavgift_prop_alminnelig * param_elavgift_sats_alminnelig"
    " + param_elavgift_prop_redusert * param_elavgift_sats_redusert)",
    "levy_normal": "cnp * (param_elavgift_prop_alminnelig * param_elavgift_sats_alminnelig_normal"
    " + param_elavgift_prop_redusert * param_elavgift_sats_redusert_normal)",
}

# Terms of each input set, and the condition for the set where a term alone does not imply it.
SETS = {
    "pro": ["pro"],
    "alt": ["alt"],
    "hydro": ["v", "mv"],
    "spot": ["v", "vp", "vs", "mv", "mvp", "mvs"],
    "support": ["vs", "mvs"],
    "levy": ["levy"],
    "levy_normal": ["levy_normal"],
    "state": ["v", "vp", "vs", "mv", "mvp", "mvs", "levy", "levy_normal"],
    "state_normal": ["v", "mv", "levy_normal"],
}
KNOWN = {
    "spot": "vp IS NOT NULL",
    "state": "vp IS NOT NULL AND levy IS NOT NULL",
    "state_normal": "v IS NOT NULL AND levy_normal IS NOT NULL",
}
BASIS = [f"{group}__{term}" for group, terms in SETS.items() for term in terms]

OWNERS = ["statkraft", "kommfylk", "private"]
KINDS = ["spot", "normal", "ekstra"]  # at market price, at the baseline price, the difference

# Part of the hydropower income that each line takes.
LINES = {
    "inntekt_normert": "1D",
    "inntekt_faktisk": "param_prop_inntekt_faktisk",
    "grunnrenteskatt": "param_skatt_grunnrente",
    "selskapsskatt": "param_prop_inntekt_faktisk * param_skatt_selskap",
    "skatt": "param_prop_inntekt_faktisk * param_skatt_selskap + param_skatt_grunnrente",
    "resultat_til_eiere": "param_prop_inntekt_faktisk * (1 - param_skatt_selskap)"
    " - param_skatt_grunnrente",
}


def used_basis(expressions: Iterable[str]) -> list[str]:
    """Basis columns that the expressions read, running totals included."""
    words = set(re.findall(r"\w+", " ".join(expressions)))
    return [c for c in BASIS if c in words or f"cum__{c}" in words]


def rated(basis: Iterable[str]) -> list[str]:
    """Basis columns that scale with the support rate."""
    return [c for c in basis if c.split("__")[1] in ("vs", "mvs")]


def guards(basis: Sequence[str]) -> dict[str, str]:
    """For each column one of its set: NULL on the same rows, so it can count gaps for all."""
    first: dict[str, str] = {}
    return {c: first.setdefault(c.split("__")[0], c) for c in basis}


def with_basis(rows: DataFrame, basis: Sequence[str] = tuple(BASIS)) -> DataFrame:
    """Basis of rows that carry the balance, the share and the tariffs."""

    def masked(column: str) -> str:
        group, term = column.split("__")
        value = f"CASE WHEN {KNOWN[group]} THEN {term} END" if group in KNOWN else term
        return f"{value} AS {column}"

    terms = [f"{text} AS {name}" for name, text in TERMS.items()]
    return rows.selectExpr("*", *terms).selectExpr(*rows.columns, *map(masked, basis))


def support_rate(price_mean: Column, floor: Column) -> Column:
    """Monthly mean price above the floor, never negative."""
    return pmax(price_mean - floor, 0)


def rate_support(rows: DataFrame, rate: str, basis: Sequence[str] = tuple(BASIS)) -> DataFrame:
    """Scale the support terms. The rate is one per region and month, so this holds for rows
    and for sums inside a month alike."""
    return rows.withColumns({c: F.expr(f"{c} * {rate}") for c in rated(basis)})


def with_coefficients(scenarios: DataFrame) -> DataFrame:
    """Products of scenario parameters, computed on the grid and not per row."""
    lines = {
        f"k_{line}": f"param_prop_spot_eksponert * ({part})" for line, part in LINES.items()
    }
    owners = {
        f"k_{owner}": f"k_resultat_til_eiere * param_prop_{owner}" for owner in OWNERS
    }
    others = {
        "k_household": "param_prop_spot_eksponert * param_prop_hushold",
        "k_normal_margin": "param_price_baseline - param_skatteposisjon_kr",
        "k_state": "k_skatt + k_statkraft",
    }
    named = {**lines, **owners, **others}
    return scenarios.selectExpr("*", *[f"{text} AS {name}" for name, text in named.items()])


def revenue_columns(prefix: str = "") -> dict[str, str]:
    """The revenue columns as combinations of coefficients and basis values.

    Without prefix of the values of a row or of a sum, with 'cum__' of running totals.
    """

    def t(group: str, *terms: str) -> list[str]:
        return [f"{prefix}{group}__{term}" for term in terms]

    (hydro_v, hydro_mv), (support_s, support_ms) = t("hydro", "v", "mv"), t("support", "vs", "mvs")
    v, vp, vs, mv, mvp, mvs = t("spot", *SETS["spot"])
    income = {
        "spot": f"({vp} - param_skatteposisjon_kr * {v})",
        "normal": f"k_normal_margin * {hydro_v}",
        "ekstra": f"({vp} - param_price_baseline * {v})",
    }
    cost = {
        "spot": f"({vp} - {vs})",
        "normal": f"param_price_baseline * {hydro_v}",
        "ekstra": f"({vp} - {vs} - param_price_baseline * {v})",
    }
    vat = {
        "spot": f"({mvp} - {mvs})",
        "normal": f"param_price_baseline * {hydro_mv}",
        "ekstra": f"({mvp} - {mvs} - param_price_baseline * {mv})",
    }
    columns = {
        "en_vkraft": f"param_prop_spot_eksponert * {hydro_v}",
        "en_hushold_vkraft": f"k_household * {hydro_v}",
        "en_hushold_stromstotte": f"k_household * {support_s}",
        "en_hushold_stromstotte_mmva": f"k_household * ({support_s} + {support_ms})",
        "en_elavgift": t("levy", "levy")[0],
        "en_elavgift_normal": t("levy_normal", "levy_normal")[0],
    }
    for kind in KINDS:
        columns |= {f"en_{line}_{kind}": f"k_{line} * {income[kind]}" for line in LINES}
        columns |= {f"en_resultat_til_eiere_{kind}_{o}": f"k_{o} * {income[kind]}" for o in OWNERS}
        columns[f"en_hushold_kost_{kind}"] = f"k_household * {cost[kind]}"
        columns[f"en_hushold_mva_{kind}"] = f"k_household * {vat[kind]}"
    del columns["en_inntekt_faktisk_ekstra"]

    v, vp, vs, mv, mvp, mvs, levy, levy_normal = t("state", *SETS["state"])
    normal_v, normal_mv, normal_levy = t("state_normal", *SETS["state_normal"])
    extra = (
        f"k_state * ({vp} - param_price_baseline * {v})"
        f" + k_household * ({mvp} - {mvs} - param_price_baseline * {mv}) + ({levy} - {levy_normal})"
    )
    return columns | {
        "en_staten_spot": f"k_state * ({vp} - param_skatteposisjon_kr * {v})"
        f" + k_household * ({mvp} - {mvs}) + {levy}",
        "en_staten_normal": f"k_state * k_normal_margin * {normal_v}"
        f" + k_household * param_price_baseline * {normal_mv} + {normal_levy}",
        "en_staten_ekstra": extra,
        "en_staten_ekstra_etter_stotte": f"{extra} - k_household * ({vs} + {mvs})",
    }


def measures(names: Sequence[str]) -> Mapping[str, str]:
    """Expressions of the named output columns and of their running totals ('_cum')."""
    every = {"pro": "pro__pro", "alt_til_spotpris": "alt__alt"} | revenue_columns()
    every |= {"pro_cum": "cum__pro__pro", "alt_til_spotpris_cum": "cum__alt__alt"}
    every |= {f"{name}_cum": text for name, text in revenue_columns("cum__").items()}
    return {name: every[name] for name in names if name in every}
