"""Input schemas and the output column contract."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_s, _d = T.StringType(), T.DoubleType()

# Landed JSON documents.
DAILY_PRICES_JSON = _struct(
    historic=_struct(
        dates=T.ArrayType(_s),
        prices=T.ArrayType(_struct(name=_s, displayName=_s, data=T.ArrayType(_d))),
    )
)
# Cells of the price matrix are text or numbers; a VARIANT keeps what they are.
HOURLY_PRICES_JSON = _struct(columns=T.ArrayType(_s), rows=T.ArrayType(T.ArrayType(T.VariantType())))
DAILY_ITEMS_JSON = _struct(items=T.ArrayType(_struct(date=_s, zone=_s, MWh=_d)))
HOURLY_ITEMS_JSON = _struct(items=T.ArrayType(_struct(date=_s, hours=_s, zone=_s, MWh=_d)))

# Landed CSV files with a header.
POWER_CSV = _struct(date=T.DateType(), zone=_s, MWh=_d)
PRICES_CSV = _struct(name=_s, displayName=_s, value=_d, date=T.DateType(), region=_s)

# Statistics table: coded facts and code labels.
STAT_FACT = _struct(ContentsCode=_s, Produk2=_s, Tid=_s, value=_d)
STAT_LABELS = _struct(values=_s, valueTexts=_s)

# Output column names in their written order. Inside the engine a dot
# is an underscore; sinks write the dotted form.
MEASURES = [
    "alt_til_spotpris",
    "stromstotte_per_kwh",
    "en.vkraft",
    "en.inntekt.normert.spot",
    "en.inntekt.normert.normal",
    "en.inntekt.normert.ekstra",
    "en.inntekt.faktisk.spot",
    "en.inntekt.faktisk.normal",
    "en.grunnrenteskatt.spot",
    "en.grunnrenteskatt.normal",
    "en.grunnrenteskatt.ekstra",
    "en.selskapsskatt.spot",
    "en.selskapsskatt.normal",
    "en.selskapsskatt.ekstra",
    "en.skatt.spot",
    "en.skatt.normal",
    "en.skatt.ekstra",
    "en.resultat_til_eiere.spot",
    "en.resultat_til_eiere.normal",
    "en.resultat_til_eiere.ekstra",
    "en.resultat_til_eiere.spot.statkraft",
    "en.resultat_til_eiere.spot.kommfylk",
    "en.resultat_til_eiere.spot.private",
    "en.resultat_til_eiere.normal.statkraft",
    "en.resultat_til_eiere.normal.kommfylk",
    "en.resultat_til_eiere.normal.private",
    "en.resultat_til_eiere.ekstra.statkraft",
    "en.resultat_til_eiere.ekstra.kommfylk",
    "en.resultat_til_eiere.ekstra.private",
    "en.hushold.vkraft",
    "en.hushold.stromstotte",
    "en.hushold.stromstotte.mmva",
    "en.hushold.kost.spot",
    "en.hushold.kost.normal",
    "en.hushold.kost.ekstra",
    "en.hushold.mva.spot",
    "en.hushold.mva.normal",
    "en.hushold.mva.ekstra",
    "en.elavgift.normal",
    "en.elavgift",
    "en.staten.spot",
    "en.staten.normal",
    "en.staten.ekstra",
    "en.staten.ekstra_etter_stotte",
]
TARIFFS = [
    "param_mva",
    "param_stromstotte_floor",
    "param_stromstotte_prop",
    "param_elavgift_prop_alminnelig",
    "param_elavgift_prop_redusert",
    "param_elavgift_prop_fritatt",
    "param_elavgift_sats_redusert_normal",
    "param_elavgift_sats_alminnelig_normal",
    "param_elavgift_sats_redusert",
    "param_elavgift_sats_alminnelig",
]
SCENARIO = [
    "freq",
    "start_date",
    "param_price_baseline",
    "param_skatt_grunnrente",
    "param_skatt_selskap",
    "param_prop_spot_eksponert",
    "param_prop_hushold",
    "param_prop_inntekt_faktisk",
    "param_prop_statkraft",
    "param_prop_kommfylk",
    "param_prop_private",
    "na.rm",
]
HEADLINE = ["en.staten.spot", "en.staten.normal", "en.staten.ekstra"]

REVENUE = [m for m in MEASURES if m.startswith("en.")]
RUNNING = ["pro", "alt_til_spotpris", *REVENUE]
RESULT = [
    "group",
    "date",
    "region",
    "pro",
    "cnp",
    "price",
    "ssb_prop_vannkraft",
    "year_month",
    "quarter",
    "price_monthly_mean",
    *TARIFFS,
    *MEASURES,
    "region.name",
    *[f"{c}.cum" for c in RUNNING],
    *SCENARIO,
]
MINIMAL = [
    "group",
    "freq",
    "date",
    *[c for c in SCENARIO if c.startswith("param_")],
    *HEADLINE,
    *[f"{c}.cum" for c in HEADLINE],
]


def plain(name: str) -> str:
    """Engine name of an output column."""
    return name.replace(".", "_")


DOTTED = {plain(name): name for name in RESULT}
