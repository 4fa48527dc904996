"""Queries against their SQL on rows that the small tables do not hold: values that share a suffix, large keys, repeated names."""

import duckdb
import pytest

from quietlake.plans import registry

from test_queries import plain

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def against(spark, tmp_path_factory):
    """Whether a query on a table of these rows is as its SQL says."""

    def run(name, table, rows, schema):
        at = str(tmp_path_factory.mktemp("copies"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
        got, want = plain(registry.queries()[name](spark, at).toPandas()), plain(con.sql(registry.oracle_sql()[name]).df())
        assert got.astype(str).values.tolist() == want.astype(str).values.tolist() and len(got)
        return got

    return run


def customers(keys):
    return [(k, f"Customer#{k:09d}", 1, 1.0, "A") for k in keys]


#: Even customers 1344 and 28234 share a suffix by their names, 2776 and 4470 by their keys in numerals.
@pytest.mark.parametrize("name", ["forward_values", "forward_in_runs"])
def test_shared_suffixes(against, name):
    rows = customers([1344, 28234, 2776, 4470, 7, 9, 10**10 + 2, 10**10 + 9])
    rows += [(1345, "Customer#000001344", 1, 1.0, "A")]  # an odd one with the name of an even one
    assert len(set(against(name, "customer", rows, CUSTOMER)["text"])) >= 7


def documents(rows):
    return [(i, t, "en", "s1", len(t)) for i, t in rows]


#: These two addresses share a suffix, so do these two phone numbers; the lengths of the addresses are even and odd.
MAILS = ["c1751@shop.example", "c4518@shop.example"]
PHONES = ["13800000050", "13800006446"]


@pytest.mark.parametrize("name", ["mapping_distinct_values", "restore_accounting"])
def test_shared_suffixes_in_documents(against, name):
    rows = [(i, f"to {m} or {p} today") for i, (m, p) in enumerate(zip(MAILS, PHONES))]
    against(name, "documents", documents(rows), DOCUMENTS)


def test_validators_of_large_keys(against):
    got = against("validators_more", "customer", customers([3, 65533, 65534, 65535, 65536, 70000, 70001]), CUSTOMER)
    assert got["ipv6"].sum() == 2


def test_values_that_look_made_up(against):
    """The hash of this id has less than three bits a character."""
    against("answer_scan", "documents", documents([(50000000998, "a"), (8, "b"), (9, "c")]), DOCUMENTS)
