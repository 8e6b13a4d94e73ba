"""Quality cutoffs: the joint test of a stratum's set, and the SQL where a set is certified."""

import hashlib
import math

import duckdb
from fixtures import SCHEMA
from pyspark.sql import functions as F

from orbweave.llm import quality_rules, queries

PLAIN = "a plain and simple text that has enough different words to pass all of the base rules of this scan today {}"


def selects(i):
    return hashlib.md5(str(i).encode()).hexdigest()[0] in quality_rules.SELECTED


def cutoffs(spark, texts):
    """The cutoffs of stratum ``en`` if all these texts are good."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    return dict(zip(quality_rules.GRID, quality_rules.fit_cutoffs(quality_rules.measure(docs), labels).first().cutoffs, strict=True))


def least():
    """Good documents that a single stratum needs in the tested part."""
    return math.ceil(math.log(quality_rules.DELTA) / math.log(1 - quality_rules.RISK))


def test_a_stratum_needs_the_least_number_of_documents(spark):
    enough, n = [], 0
    while n < least():
        n += not selects(len(enough))
        enough.append(PLAIN.format(len(enough)))
    assert not selects(len(enough) - 1)
    assert cutoffs(spark, enough)["symbol_ratio"] == quality_rules.GRID["symbol_ratio"][1]
    assert set(cutoffs(spark, enough[:-1]).values()) == {None}


def test_ratios_share_the_risk(spark):
    """Two ratios whose cutoffs reject 2 % of the good documents each keep the risk of 3 % one by one, but not together."""
    n = 6000
    place = {i: k for k, i in enumerate(i for i in range(n) if not selects(i))}

    def text(i, loud, odd):
        k = place.get(i, 99) % 50
        return PLAIN.format(i) + (" ###########" if odd and k == 0 else "") + (" NNNNNNNNNNNNNNNNNNNNNNNNNNNN" if loud and k == 1 else "")

    one = cutoffs(spark, [text(i, True, False) for i in range(n)])
    both = cutoffs(spark, [text(i, True, True) for i in range(n)])
    assert one["upper_ratio"] == quality_rules.GRID["upper_ratio"][1]
    # the looser set, whose cutoffs few exceed, is what remains
    assert both["symbol_ratio"] is None or both["symbol_ratio"] > one["symbol_ratio"]


def test_query_equals_sql_where_a_set_is_certified(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = c.sql(queries.oracle_sql()["op7_quality_rules"])
    columns = list(expected.columns)
    got = [tuple(r[k] for k in columns) for r in queries.op7_quality_rules(spark, sf).collect()]
    assert sorted(got) == sorted(expected.fetchall())
    assert any(not r[columns.index("kept")] and not r[columns.index("base_failed")] for r in got)
