"""Country and nationality codes of travel documents."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import constant_map

#: Codes of travel documents beyond the three-letter codes of countries.
SPECIAL = {
    "D": "Germany",
    "UTO": "Utopia",
    "XXA": "Stateless person",
    "XXB": "Refugee",
    "XXC": "Refugee or protected person",
    "XXX": "Unspecified nationality",
    "EUE": "European Union",
    "UNO": "United Nations",
    "XOM": "Sovereign Military Order of Malta",
}

#: Names on travel documents that differ from the locale data's.
NAMES = {
    "BES": "Bonaire, Sint Eustatius and Saba",
    "BRN": "Brunei Darussalam",
    "CPV": "Cabo Verde",
    "CCK": "Cocos Islands",
    "COG": "Congo",
    "COD": "Congo, Democratic Republic of the",
    "CIV": "Côte d'Ivoire",
    "HMD": "Heard Island and McDonald Islands",
    "VAT": "Holy See",
    "HKG": "Hong Kong",
    "PRK": "Korea, Democratic People's Republic of",
    "KOR": "Korea, Republic of",
    "LAO": "Lao People's Democratic Republic",
    "MAC": "Macao",
    "MMR": "Myanmar",
    "PSE": "Palestine",
    "PCN": "Pitcairn",
    "RUS": "Russian Federation",
    "VCT": "Saint Vincent and the Grenadines",
    "STP": "Sao Tome and Principe",
    "SGS": "South Georgia and the South Sandwich Islands",
    "SYR": "Syrian Arab Republic",
    "TUR": "Türkiye",
    "UMI": "United States Minor Outlying Islands",
    "USA": "United States of America",
    "VNM": "Viet Nam",
    "VGB": "Virgin Islands, British",
    "VIR": "Virgin Islands, U.S.",
}


@lru_cache
def _of_jvm(jvm_id: int, jvm) -> dict[str, str]:
    english = jvm.java.util.Locale.ENGLISH
    found = {}
    for two in jvm.java.util.Locale.getISOCountries():
        place = jvm.java.util.Locale("", two)
        name = place.getDisplayCountry(english).replace(" & ", " and ")
        found[place.getISO3Country()] = f"Saint {name[4:]}" if name.startswith("St. ") else name
    return found | NAMES | SPECIAL


def country_names(spark: SparkSession | None = None) -> dict[str, str]:
    """Code -> name: the platform's list of countries, with the names and codes above."""
    spark = spark or SparkSession.active()
    return _of_jvm(id(spark.sparkContext), spark._jvm)


def country_table(spark: SparkSession) -> DataFrame:
    """The dimension (code, name)."""
    return spark.createDataFrame(sorted(country_names(spark).items()), "code string, name string")


def country_map(names: dict[str, str] | None = None) -> Column:
    return constant_map(names or country_names())


def normal_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), "[^A-Z]", "")


def country_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """The name of a code; the code itself where it is unknown."""
    return F.coalesce(F.try_element_at(country_map(names), normal_code(code)), normal_code(code))


def is_known_code(code: Column, names: dict[str, str] | None = None) -> Column:
    return F.map_contains_key(country_map(names), normal_code(code))
