import datetime as dt

import pytest
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.operators import revenue, tariffs
from tailrace.operators.scenarios import Scenario, expand_scenarios
from tailrace.schemas import plain

# pro 1000, cnp 800, price 1.2, monthly mean 1.0, share .9, region no1, 2022-02-15
GOLDEN = {
    "alt_til_spotpris": 1200, "stromstotte_per_kwh": 0.24,
    "en.vkraft": 630, "en.inntekt.normert.spot": 693,
    "en.inntekt.normert.normal": 157.5, "en.inntekt.normert.ekstra": 535.5,
    "en.inntekt.faktisk.spot": 623.7, "en.inntekt.faktisk.normal": 141.75,
    "en.grunnrenteskatt.spot": 256.41, "en.grunnrenteskatt.normal": 58.275,
    "en.grunnrenteskatt.ekstra": 198.135,
    "en.selskapsskatt.spot": 137.214, "en.selskapsskatt.normal": 31.185,
    "en.selskapsskatt.ekstra": 106.029,
    "en.skatt.spot": 393.624, "en.skatt.normal": 89.46, "en.skatt.ekstra": 304.164,
    "en.resultat_til_eiere.spot": 230.076, "en.resultat_til_eiere.normal": 52.29,
    "en.resultat_til_eiere.ekstra": 177.786,
    "en.resultat_til_eiere.spot.statkraft": 96.63192,
    "en.resultat_til_eiere.spot.kommfylk": 124.24104,
    "en.resultat_til_eiere.spot.private": 9.20304,
    "en.resultat_til_eiere.normal.statkraft": 21.9618,
    "en.resultat_til_eiere.normal.kommfylk": 28.2366,
    "en.resultat_til_eiere.normal.private": 2.0916,
    "en.resultat_til_eiere.ekstra.statkraft": 74.67012,
    "en.resultat_til_eiere.ekstra.kommfylk": 96.00444,
    "en.resultat_til_eiere.ekstra.private": 7.11144,
    "en.hushold.vkraft": 214.2, "en.hushold.stromstotte": 51.408,
    "en.hushold.stromstotte.mmva": 64.26,
    "en.hushold.kost.spot": 205.632, "en.hushold.kost.normal": 74.97,
    "en.hushold.kost.ekstra": 130.662,
    "en.hushold.mva.spot": 51.408, "en.hushold.mva.normal": 18.7425,
    "en.hushold.mva.ekstra": 32.6655,
    "en.elavgift": 39.90288, "en.elavgift.normal": 74.13488,
    "en.staten.spot": 581.5668, "en.staten.normal": 204.29918,
    "en.staten.ekstra": 377.26762, "en.staten.ekstra_etter_stotte": 313.00762,
}

ROW = {
    "date": dt.date(2022, 2, 15), "region": "no1", "pro": 1000.0, "cnp": 800.0, "price": 1.2,
    "ssb_prop_vannkraft": 0.9, "price_monthly_mean": 1.0,
}
SCHEMA = "date date, region string, pro double, cnp double, price double, ssb_prop_vannkraft double, price_monthly_mean double"


def revenue_row(spark, scenario=Scenario(), **changes):
    row = spark.createDataFrame([tuple({**ROW, **changes}.values())], SCHEMA)
    basis = revenue.with_basis(tariffs.with_tariffs(row))
    rate = revenue.support_rate(F.col("price_monthly_mean"), F.col("param_stromstotte_floor"))
    rated = revenue.rate_support(basis.withColumn("rate", rate), "rate").withColumn("variant", F.lit(0))
    columns = dict(revenue.measures([plain(m) for m in schemas.MEASURES]))
    columns["stromstotte_per_kwh"] = "rate * param_stromstotte_prop"
    return expand_scenarios(rated, spark, [scenario], [f"{c} AS {n}" for n, c in columns.items()]).first()


def test_golden_row(spark):
    got = revenue_row(spark)
    assert set(GOLDEN) == set(schemas.MEASURES)
    for name, value in GOLDEN.items():
        assert got[plain(name)] == pytest.approx(value, rel=1e-12), name


def test_no_vat_in_the_free_region(spark):
    got = revenue_row(spark, region="no4")
    assert got.en_hushold_mva_spot == 0 and got.en_hushold_stromstotte_mmva == got.en_hushold_stromstotte


# Revenue columns that are NULL when one input is, by the inputs they need.
HYDRO = {m for m in schemas.REVENUE if m.endswith((".normal", "vkraft")) or ".normal." in m}
HYDRO -= {"en.elavgift.normal", "en.staten.normal"}
SUPPORT = {"en.hushold.stromstotte", "en.hushold.stromstotte.mmva"}
LEVIES = {"en.elavgift", "en.elavgift.normal"}
STATE = {m for m in schemas.REVENUE if m.startswith("en.staten")}
SPOT = set(schemas.REVENUE) - HYDRO - SUPPORT - LEVIES - STATE


@pytest.mark.parametrize(
    ("change", "lost"),
    [
        ({"pro": None}, HYDRO | SUPPORT | SPOT | STATE),
        ({"ssb_prop_vannkraft": None}, HYDRO | SUPPORT | SPOT | STATE),
        ({"price": None}, SPOT | STATE - {"en.staten.normal"}),
        ({"price": None, "price_monthly_mean": None}, SUPPORT | SPOT | STATE - {"en.staten.normal"}),
        ({"cnp": None}, LEVIES | STATE),
        ({"date": dt.date(2020, 12, 31)}, {"en.elavgift"} | STATE - {"en.staten.normal"}),
    ],
)
def test_missing_input(spark, change, lost):
    got = revenue_row(spark, **change)
    assert {m for m in schemas.REVENUE if got[plain(m)] is None} == lost


def test_identities(spark):
    got = revenue_row(spark, Scenario(param_price_baseline=0.61, param_prop_hushold=0.2, param_skatt_selskap=0.3))
    for m in schemas.REVENUE:
        if m.endswith(".ekstra"):
            spot, normal = (got[plain(m.replace("ekstra", k))] for k in ("spot", "normal"))
            assert got[plain(m)] == pytest.approx(spot - normal, rel=1e-9, abs=1e-9), m
    for kind in ("spot", "normal", "ekstra"):
        whole = got[f"en_resultat_til_eiere_{kind}"]
        parts = [got[f"en_resultat_til_eiere_{kind}_{o}"] for o in ("statkraft", "kommfylk", "private")]
        assert sum(parts) == pytest.approx(whole)


def test_basis_names():
    used = revenue.used_basis(revenue.measures(["en_staten_spot", "en_staten_normal_cum"]).values())
    assert {c.split("__")[0] for c in used} == {"state", "state_normal"}
    assert set(revenue.used_basis(revenue.measures([plain(m) for m in schemas.RUNNING]).values())) == set(revenue.BASIS)
    assert set(revenue.guards(revenue.BASIS).values()) <= set(revenue.BASIS)
    assert len(schemas.RESULT) == 121 and len(schemas.MINIMAL) == 18
