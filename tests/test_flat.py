"""Tables so large that every cell of the derived images holds one level, against the SQL."""

import math

import duckdb
import pytest

from corrgrid.plans import REFERENCE, REFERENCE_SQL


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    path = tmp_path_factory.mktemp("flat")
    duckdb.sql(f"""COPY (SELECT i % 64 AS l_orderkey, (i // 64) % 64 AS l_partkey, (i // 4096) % 32 AS l_suppkey, (i % 7 + 1)::INT AS l_linenumber, 50.0::DOUBLE AS l_quantity,
        (104990.0 + i % 9 - CASE WHEN i % 4096 = 77 AND (i // 4096) % 2 = 1 THEN 2000 ELSE 0 END)::DOUBLE AS l_extendedprice, (i % 11) / 100.0::DOUBLE AS l_discount, (i % 9) / 100.0::DOUBLE AS l_tax
        FROM range(131072) t(i)) TO '{path}/lineitem.parquet' (FORMAT parquet)""")
    return path


@pytest.mark.parametrize("name", ["gradient_correlation", "gradient_zncc", "masked_errors", "min_max", "quality_first", "quality_measured", "stretch_valid", "zncc"])
def test_images_of_one_level(spark, flat, name):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS FROM '{flat}/lineitem.parquet'")
        df = REFERENCE[name](spark, str(flat))
        columns = ", ".join(f'"{n}"' for n in df.columns)
        want = c.execute(f"SELECT {columns} FROM ({REFERENCE_SQL[name]})").fetchall()
    show = lambda r: tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) if x is None else float(x) for x in r)
    assert sorted(map(str, map(show, df.collect()))) == sorted(map(str, map(show, want)))
