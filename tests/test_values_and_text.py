import math
import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import text as X
from fieldpulse.functions import values as V


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["o"] for r in df.select("i", build(F.col("c")).alias("o")).orderBy("i").collect()]


def test_text_that_spells_missing_becomes_null(spark):
    assert column(spark, [" a ", "nan", "None", "NaN", "  ", None], V.clean_string) == ["a"] + [None] * 5


def test_numbers_are_cast_leniently(spark):
    assert column(spark, ["1.5", "n/a", "NaN", "Infinity", None], V.to_number) == [1.5, None, None, None, None]
    assert column(spark, ["около -12.5 м", "7", "нет", None], V.first_number) == [-12.5, 7.0, None, None]


def test_moments_from_text_and_from_day_numbers(spark):
    got = column(spark, ["2025-01-01 12:00:00", "45658.5", "not a date", "0001-01-01", None], V.to_epoch)
    assert got == [1735732800, 1735732800, None, None, None]


def test_day_numbers_keep_whole_seconds(spark):
    seconds = [1735732800 + i for i in range(200)]
    assert column(spark, [repr(s / 86400 + 25569) for s in seconds], V.to_epoch) == seconds


def test_epoch_day_and_hour_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        row = spark.range(1).select(V.epoch_date(F.lit(1735775999)).alias("d"), V.epoch_hour(F.lit(1735775999)).alias("h"),
                                    V.epoch_day(F.lit(-1)).alias("n")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (str(row["d"]), row["h"], row["n"]) == ("2025-01-01", 23, -1)


def test_json_rows_have_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5), (4, None)], "i int, x double")
    assert [r["json"] for r in V.json_rows(df).collect()] == [
        '{"i":1,"x":null}', '{"i":2,"x":null}', '{"i":3,"x":1.5}', '{"i":4,"x":null}']


def test_white_space_of_every_kind_is_trimmed(spark):
    texts = ["\t7\u00a0", "\u2003 7", "7", " \u00a0 ", None]
    assert column(spark, texts, V.clean_string) == ["7", "7", "7", None, None]
    names = ["ЦТП\u00a0№\u00a012", "ЦТП\t12"]
    assert column(spark, names, X.norm_number) == ["12", "12"]


def test_numbers_keep_their_size(spark):
    assert column(spark, [0.0005, 12345678.5, -3.0, None], V.first_number, "double") == [0.0005, 12345678.5, -3.0, None]
    assert column(spark, ["5.5 h", "about -2e3 m", "7.", "none"], V.first_number) == [5.5, -2000.0, 7.0, None]


def test_moments_in_every_spelling(spark):
    texts = ["15.01.2024 10:00", "1/15/2024 10:00", "15.1.2024", "2024/1/15 10:00:30", "2024-01-15 10:00:00", "40.01.2024", "x"]
    assert column(spark, texts, lambda c: V.to_epoch(c)) == [
        1705312800, 1705312800, 1705276800, 1705312830, 1705312800, None, None]


def test_numbers_of_facilities(spark):
    names = ["ЦТП-1105", "ЦТП № 1-3-4", "цтп1105", "ЦТП--7-", "Котельная № 5", "ЦТП"]
    assert column(spark, names, X.norm_number) == ["1105", "1-3-4", "1105", "7", "котельная5", "цтп"]


def test_district_suffixes(spark):
    assert column(spark, ["Химки г.о.", "Мытищи г.", "г.о. Химки", "Тверь"], X.clean_district) == [
        "Химки", "Мытищи", "Химки", "Тверь"]


def test_extraction_finds_the_first_mention(spark):
    texts = ["утечка на ЦТП-1105 по ул.", "работы на ЦТП № 1-3-4, без ГВС", "авария на котельной"]
    assert column(spark, texts, lambda c: X.norm_number(X.usable_extraction(X.extract_plant(c)))) == ["1105", "1-3-4", None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_indel_ratio_against_plain_dynamic_programming(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab1-") for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    pairs = list(zip(words, reversed(words))) + [("", ""), ("a", ""), ("63", "3")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.indel_ratio("a", "b").alias("s")).collect():
        total = len(r["a"]) + len(r["b"])
        assert math.isclose(r["s"], 200 * lcs(r["a"], r["b"]) / total if total else 100.0), (r["a"], r["b"])


@pytest.mark.parametrize("word", ["", "не найдено", "Не найдено ", None])
def test_not_found_is_no_extraction(spark, word):
    assert column(spark, [word], X.usable_extraction) == [None]
