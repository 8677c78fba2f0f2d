import datetime as dt

import pytest

from fleetstats.plans import dimensions as dim


def test_time_of_day(spark):
    out = dim.time_of_day_dim(spark)
    assert out.count() == 86_400
    got = {r.id: r.time for r in out.filter("id in (0, 61, 86399)").collect()}
    assert got == {0: "00:00:00", 61: "00:01:01", 86399: "23:59:59"}


def test_date_dim(spark):
    out = dim.date_dim(spark)
    assert out.count() == 18_263 and dict(out.dtypes) == {"id": "smallint", "date": "date"}
    first, last = out.orderBy("id").first(), out.orderBy(out.id.desc()).first()
    assert (first.id, first.date) == (0, dt.date(2015, 1, 1))
    assert (last.id, last.date) == (18_262, dt.date(2064, 12, 31))
    assert dim.date_dim(spark, "2016-02-29", 1).count() == 365
    with pytest.raises(ValueError):
        dim.date_dim(spark, years=100)


def test_written_dimensions(spark, tmp_path):
    dim.write_dimensions(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/dim_date").count() == 18_263
    assert spark.read.parquet(f"{tmp_path}/dim_time_of_day").count() == 86_400
