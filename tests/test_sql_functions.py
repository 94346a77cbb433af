"""Functions in SQL give what the column builders give."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions.sql import FUNCTIONS, register_functions, register_tables


def test_every_function_as_its_builder(spark):
    names = register_functions(spark)
    assert set(names) == set(FUNCTIONS)
    for name, (build, parameters) in FUNCTIONS.items():
        fields = [(p.split(":")[0], (p.split(":") + ["double"])[1]) for p in parameters.split()]
        rows = [tuple("Ab c-Ü d" if kind == "string" else (k + 1) * x for k, (_, kind) in enumerate(fields)) for x in (0.0, 0.37, 11.0, -3.5)] + [tuple(None for _ in fields)]
        df = spark.createDataFrame(rows, ", ".join(f"{p} {kind}" for p, kind in fields))
        df.createOrReplaceTempView("arguments")
        ours = [tuple(r) for r in df.select(build(*(F.col(p) for p, _ in fields))).collect()]
        theirs = [tuple(r) for r in spark.sql(f"SELECT {name}({', '.join(p for p, _ in fields)}) FROM arguments").collect()]
        flat = lambda rows: [x for (v,) in rows for x in (tuple(v) if isinstance(v, tuple) else (v,))]
        assert flat(theirs) == pytest.approx(flat(ours), nan_ok=True) if not isinstance(flat(ours)[0], str) else theirs == ours, name


def test_table_functions(spark):
    register_tables(spark)
    spark.createDataFrame([("a", i, 45.0 + (i % 10) / 1000, 7.0, i * 100.0, 300.0 if i < 5 else None) for i in range(25)], "ride_id string, i int, lat double, lon double, dist double, watts double").createOrReplaceTempView("seconds")
    out = spark.sql("SELECT * FROM crossings(TABLE(seconds) PARTITION BY ride_id ORDER BY (i), 45.0D, 7.0D, 30D, 400D)")
    assert out.columns == ["ride_id", "i", "lat", "lon", "dist", "watts", "crossing"] and [(r["i"], r["crossing"]) for r in out.collect()] == [(0, 1), (10, 2), (20, 3)]
    left = [r["balance"] for r in spark.sql("SELECT * FROM reserve(TABLE(seconds) PARTITION BY ride_id ORDER BY (i), 250D, 1000D)").collect()]
    assert left[:5] == [950.0, 900.0, 850.0, 800.0, 750.0] and 750 < left[5] < left[-1] < 1000
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM reserve(TABLE(SELECT ride_id FROM seconds) PARTITION BY (ride_id), 250D, 1000D)").collect()
