"""Sums that decide at a threshold are taken in the order of the table."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_probabilities_at_the_threshold_match_sql_over_many_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    patients, cycles, files = 300, 24, 6
    k = rng.integers(0, 11, (patients, cycles // 2))
    discount = np.concatenate([k, 10 - k], 1) / 100  # every mean is 0.5
    at = rng.permutation(patients * cycles)
    order = np.arange(patients * cycles) // cycles
    (tmp_path / "lineitem.parquet").mkdir()
    for i, part in enumerate(np.array_split(at, files)):
        n = len(part)
        line = {"l_orderkey": order[part], "l_discount": discount.ravel()[part], **{f"l_{c}": np.zeros(n) for c in ("partkey", "suppkey", "linenumber", "quantity", "extendedprice", "tax")}, **{f"l_{c}": ["F"] * n for c in ("returnflag", "linestatus", "shipdate")}}
        pq.write_table(pa.table(line), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    pq.write_table(pa.table({"o_orderkey": np.arange(patients), "o_custkey": np.arange(patients), "o_orderstatus": ["F"] * patients, "o_orderpriority": ["1"] * patients}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": np.arange(patients), "c_mktsegment": ["A"] * patients}), tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # in the order of the table; more threads add up parts of it
    for t, path in (("lineitem", "lineitem.parquet/*.parquet"), ("orders", "orders.parquet"), ("customer", "customer.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{path}')")
    cur = con.execute(entry.oracle_sql()["aggregate_probabilities"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert len({w[names.index("predicted")] for w in want}) == 2
    assert sorted(map(tuple, entry.queries()["aggregate_probabilities"](spark, str(tmp_path)).select(*names).collect())) == want
