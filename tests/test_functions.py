import math

import pytest
from pyspark.sql import functions as F

from cadenza.config import first_set
from cadenza.functions import geo, physics, scalars, text, wind


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


def lits(*xs):
    return [F.lit(x).cast("double") if x is not None else F.lit(None).cast("double") for x in xs]


def test_air(value):
    assert value(physics.air_density(*lits(15.0, 101325.0, None))) == pytest.approx(1.225, abs=1e-3)
    assert value(physics.air_density(*lits(30.0, 101325.0, 90.0))) < value(physics.air_density(*lits(30.0, 101325.0, None)))
    assert value(physics.pressure_at_altitude(*lits(0.0))) == pytest.approx(101325)
    assert value(physics.pressure_at_altitude(*lits(None))) == pytest.approx(101325)


def test_power(value):
    def need(v, cda=0.32, crr=0.0, theta=0.0, accel=0.0, east=0.0, north=0.0):
        return value(physics.required_power(*lits(v, theta, accel, 0.0, east, north, 78.0, crr, cda, 1.2, 1.0, 0.0, 0.0)))

    assert need(10.0) == pytest.approx(0.5 * 1.2 * 0.32 * 1000)
    assert need(20.0) == pytest.approx(8 * need(10.0))
    assert need(0.05) == 0
    assert need(10.0, north=-5.0) > need(10.0) > need(10.0, north=5.0)
    assert need(10.0, theta=-0.1) < 0
    fixed, per = physics.power_terms(*lits(9.0, 0.01, 0.1, 1.0, 2.0, -1.0, 78.0, 0.004, 1.2, 0.976, 1.2, 0.15))
    assert value(fixed + per * 0.3) == pytest.approx(value(physics.required_power(*lits(9.0, 0.01, 0.1, 1.0, 2.0, -1.0, 78.0, 0.004, 0.3, 1.2, 0.976, 1.2, 0.15))))


@pytest.mark.parametrize("bearing", [0.0, 10.0, 179.0, 250.0, 350.0])
def test_bearing_round_trip(value, bearing):
    assert value(wind.wind_bearing(*wind.wind_vector(*lits(3.0, bearing)))) == pytest.approx(bearing, abs=1e-9)


def test_wind(value):
    assert value(wind.compass_name(*lits(359.0))) == "N"
    assert value(wind.compass_name(*lits(250.0))) == "WSW"
    assert wind.shelter_factor(0.1) == pytest.approx(math.log(13) / math.log(100))
    assert value(wind.shelter_factor_column(*lits(0.1))) == pytest.approx(wind.shelter_factor(0.1))
    assert value(wind.shelter_factor_column(*lits(None))) == pytest.approx(wind.shelter_factor(0.1))


def test_scalars(value):
    assert value(scalars.clamp(F.lit(None).cast("double"), 1, 2)) is None
    assert value(scalars.clamp(F.lit(3.0), 1, 2)) == 2
    assert value(scalars.half_up(F.lit(-0.5))) == 0
    assert value(scalars.angle_delta(F.lit(3.0), F.lit(-3.0))) == pytest.approx(2 * math.pi - 6)
    assert value(scalars.angle_delta(F.lit(0.0), F.lit(math.pi))) == pytest.approx(math.pi)
    assert value(scalars.lerp(*lits(None, 4.0, 0.25))) == 4
    assert value(scalars.lerp(*lits(None, None, 0.25))) is None
    assert value(first_set(*lits(0.0, None, 5.0))) == 5
    assert value(first_set(*lits(0.0, None))) == 0
    assert value(first_set(*lits(None, None))) == 0


def test_geo(value):
    assert value(geo.planar_metres(*lits(45.0, 7.0, 45.001, 7.0))) == pytest.approx(111.32)
    assert value(geo.haversine_km(*lits(0.0, 0.0, 0.0, 180.0))) == pytest.approx(math.pi * 6371)
    assert [value(geo.corner_kind(F.lit(d))) for d in (150, 90, 40, 20)] == ["hairpin", "square", "sweeper", "kink"]


def test_text(value):
    assert value(text.slug(F.lit("Riverside Crit #3 !!"))) == "riverside-crit-3"
    assert value(text.ride_id(F.lit("icu"), F.lit("i7"), F.lit(1.0), F.lit("x"))) == "icu-i7"
    assert value(text.ride_id(F.lit("fit"), F.lit(None).cast("string"), F.lit(5.0), F.lit("A b"))) == "fit-5-a-b"
    assert value(text.name_of_file(F.lit("_-.fit"))) == "Race"
    assert value(text.zoned_iso(F.lit("2026-06-07T17:30:00"))) == "2026-06-07T17:30:00Z"
    assert value(text.zoned_iso(F.lit("2026-06-07T17:30:00+02:00"))) == "2026-06-07T17:30:00+02:00"
    assert value(text.activity_ref(F.lit("https://x.org/activities/i123?a=1"))) == "i123"
    assert value(text.activity_ref(F.lit("nothing"))) is None
    assert [value(text.clock(F.lit(s))) for s in (59.6, 3661.0)] == ["1:00", "1:01:01"]
    assert value(text.clock(F.lit(None).cast("double"))) == "—"
    assert value(text.is_ride(F.lit("virtualride"))) and not value(text.is_ride(F.lit(None).cast("string")))
