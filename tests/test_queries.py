"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quern.plans import oracle, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{v + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(one, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"stream_redact"}


def test_streamed_conversations_are_released_to_their_end(spark):
    from pyspark.sql import functions as F

    from quern.functions import pii

    got = {}
    for r in queries.stream_redact(spark, DIR).orderBy("request_id", "seq").collect():
        got[r.request_id] = got.get(r.request_id, "") + r.text
    talk = spark.read.parquet(f"{DIR}/conversations.parquet").groupBy(F.col("conv_id").cast("string").alias("id"))
    whole = talk.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("t")))), lambda s: s["t"]), "").alias("t"))
    want = whole.withColumn("s", pii.spans(F.col("t"))).select("id", pii.redact(F.col("t"), F.col("s")).alias("o")).collect()
    assert got == {r.id: r.o for r in want}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
