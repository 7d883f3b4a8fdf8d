import math

from pyspark.sql import functions as F

from harborline import schema
from harborline.functions import exact, scalars


def values(spark, cells, make, kind="double"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def test_levels_at_their_limits(spark):
    cells = [0.0, 0.29, 0.3, 0.5499, 0.55, 0.75, 1.0, None]
    assert values(spark, cells, scalars.level) == [
        "low", "low", "medium", "medium", "high", "critical", "critical", None
    ]
    advice = values(spark, [0.3, 0.75, 1.0, None], scalars.advice)
    assert advice == ["Monitor closely, prepare alternate", schema.TOP_ADVICE, schema.TOP_ADVICE, None]


def test_numbers_and_flags_from_text(spark):
    assert values(spark, ["", "abc", " 1.5 ", None], scalars.num, "string") == [None, None, 1.5, None]
    assert values(spark, ["", "7"], lambda c: scalars.num(c, 0), "string") == [0.0, 7.0]
    cells = ["YES", "t", "1", "True", "no", "", None]
    assert values(spark, cells, scalars.flag, "string") == [True] * 4 + [False] * 3


def test_defaults_replace_zero_and_null(spark):
    assert values(spark, [0.0, None, 3.0], lambda c: scalars.or_default(c, 2)) == [2.0, 2.0, 3.0]


def test_clamp_keeps_null(spark):
    assert values(spark, [-1.0, 0.4, 7.0, None], scalars.clamp) == [0.0, 0.4, 1.0, None]


def test_distance_and_match(spark):
    row = spark.range(1).select(
        scalars.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        scalars.location_match(F.lit("port of los santos"), F.lit("Los_Angeles")).alias("yes"),
        scalars.location_match(F.lit("Lisbon"), F.lit("Los_Angeles")).alias("no"),
    ).first()
    assert math.isclose(row.half, math.pi * 6371) and row.yes and not row.no


def test_short_id_is_stable(spark):
    first = values(spark, ["Tokyo", "Suez"], scalars.short_id, "string")
    assert first == values(spark, ["Tokyo", "Suez"], scalars.short_id, "string")
    assert all(len(i) == 7 and i.startswith("BN-") for i in first)


def test_exact_mean_and_rounding(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "c double")
    assert df.select(exact.exact_mean(F.col("c"))).first()[0] == 0.15
    assert df.where("c > 9").select(exact.exact_mean(F.col("c"))).first()[0] is None
    assert values(spark, [2.675, -79.50025], lambda c: exact.rounded(c, 2)) == [2.68, -79.5]


def test_long_numbers_keep_their_digits(spark):
    from harborline.sources import views

    df = spark.createDataFrame([(7,), (1234567890,), (1234567891,)], "n bigint")
    keys = [r[0] for r in df.select(views.numbered("SHP-", F.col("n"))).collect()]
    assert keys == ["SHP-000000007", "SHP-1234567890", "SHP-1234567891"]
