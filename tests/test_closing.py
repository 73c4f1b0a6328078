"""Facts on streams whose last rows in time find no partners: the closing row brings them out."""

import duckdb
import pytest

from .test_oracle import test_oracle as agree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Order 1 has a line near to it that has neither coupon nor activity, order 300 one that is too far."""
    path = str(tmp_path_factory.mktemp("tables"))
    c = duckdb.connect()
    for t in ("customer", "part", "supplier", "nation", "region"):
        c.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet') TO '{path}/{t}.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * EXCLUDE n REPLACE (CASE n WHEN 1 THEN 1 ELSE 300 END AS o_orderkey, TIMESTAMP '2001-01-01' AS o_orderdate, 'F' AS o_orderstatus) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM '/root/testdata/sf0.001/orders.parquet') WHERE n <= 2) TO '{path}/orders.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * EXCLUDE n REPLACE (CASE n WHEN 1 THEN 1 ELSE 300 END AS l_orderkey, 1 AS l_linenumber, 0.0 AS l_discount, 0.0 AS l_tax) FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM '/root/testdata/sf0.001/lineitem.parquet') WHERE n <= 2) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", ["stream_order_detail", "stream_pay_detail"])
def test_last_rows_come_out(spark, folder, name):
    c = duckdb.connect()
    for t in ("customer", "part", "supplier", "nation", "region", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    agree(spark, folder, c, name)
