"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandline.plans import bipartite_queries, catalogue, link_queries, text_queries, transfer_queries

from .conftest import SMALL


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def made_once():
    """What many queries begin with is made once here; each query still reads it through its own plan."""
    patch, held = pytest.MonkeyPatch(), {}

    def once(owner, name, key=lambda a: a[2:]):
        make = getattr(owner, name)

        def get(*args, **more):
            k = (id(owner), name, key(args))
            if k not in held:
                held[k] = make(*args, **more)
            return held[k]

        patch.setattr(owner, name, get)

    itself = lambda a: id(a[0])
    once(transfer_queries.Banks, "links", itself)
    once(bipartite_queries.Snapshot, "scored", itself)
    once(link_queries, "scored")
    once(link_queries, "Tables")
    once(link_queries, "scored_self")
    once(transfer_queries, "Banks")
    once(bipartite_queries, "Snapshot")
    once(text_queries, "Found")
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions", [3, 11])
def test_ties_do_not_depend_on_partitions(spark, partitions):
    """The order of adding must not split a tie at the edge of a ranking."""
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = catalogue.queries()["bm25_topk"](spark, d).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows(got) == rows(con.sql(catalogue.oracle_sql()["bm25_topk"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
