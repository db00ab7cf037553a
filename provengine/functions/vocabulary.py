"""Controlled vocabularies as dimension tables: a code and a display name, small enough to send along.

Languages and countries are those that the provider reports: ISO 639-1 and ISO 3166-1 with their English names, as the Java
platform that Spark runs on lists them, but for the fixed differences below. Another vocabulary is data: give its file
(two columns, code and name) as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ISO codes that the provider doesn't report (outdated ones, and a few others), and codes that it does beyond
# the platform's list. The new forms of outdated codes stand here too, since old platforms lack them.
LANGUAGES_LEFT_OUT = ("bh", "ho", "ik", "in", "iw", "ji", "kl", "mo")
LANGUAGES_ADDED = {"he": "Hebrew", "id": "Indonesian", "sh": "Serbo-Croatian", "yi": "Yiddish"}
COUNTRIES_LEFT_OUT = ("EH", "TF", "UM")
COUNTRIES_ADDED = {"XK": "Kosovo"}


def _iso(spark: SparkSession, codes: str, name: str, locale, left_out: tuple[str, ...], added: dict[str, str]) -> DataFrame:
    java = spark.sparkContext._jvm.java.util.Locale
    known = {code: getattr(locale(java, code), name)(java.ENGLISH) for code in getattr(java, codes)() if code not in left_out}
    return spark.createDataFrame(sorted((known | added).items()), "code string, name string")


def languages(spark: SparkSession) -> DataFrame:
    """Two-letter codes in lower case."""
    return _iso(spark, "getISOLanguages", "getDisplayLanguage", lambda java, code: java(code), LANGUAGES_LEFT_OUT, LANGUAGES_ADDED)


def countries(spark: SparkSession) -> DataFrame:
    """Two-letter codes in upper case."""
    return _iso(spark, "getISOCountries", "getDisplayCountry", lambda java, code: java("", code), COUNTRIES_LEFT_OUT, COUNTRIES_ADDED)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file (CSV with a header: code, name)."""
    return spark.read.schema("code string, name string").option("header", True).csv(path)
