"""Each query of the core against its SQL, over whole tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.plans.oracle import ORACLE_SQL
from spanloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


def test_outcomes_differ(spark):
    assert {r.decision for r in QUERIES["decisions"](spark, SF).select("decision").distinct().collect()} == {"accepted", "review", "rejected"}


def test_only_the_classifier_has_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"classifier_scores"}


def test_a_sample_holds_a_share_of_each_vector(spark):
    from spanloom.operators import learn

    features = [F.lit(1).alias(c) for c in learn.FEATURES[1:]]
    rows = spark.range(4000).select((F.col("id") % 40).cast("int").alias("token_count"), *features, (F.col("id") % 40 >= 20).cast("int").alias("label"), F.col("id").alias("start"))
    model = learn.train(rows, rounds=3, at_most=400)
    assert model is not None
    assert learn.scored(rows, model).where((F.col("p") > 0.5) == (F.col("label") == 1)).count() >= 3800


def test_long_conversations_keep_their_turns(spark, tmp_path):
    turns = [(1, 0), (1, 9_999), (1, 10_000), (1, 25_003), (2, 0), (2, 5_003)]
    spark.createDataFrame([(c, t, "so said Dr. Anna Smith") for c, t in turns], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["session_roster"](spark, str(tmp_path)).where("name = 'anna smith'").collect()}
    assert set(got) == {1, 2} and (got[1].first_turn, got[1].last_turn) == (0, 25_003) and (got[2].first_turn, got[2].last_turn) == (0, 5_003)
    assert {(r.conv_id, r.turn) for r in QUERIES["roster_vouchers"](spark, str(tmp_path)).collect()} <= set(turns)


def test_classifier(spark, tmp_path):
    from spanloom.operators import learn

    scores = QUERIES["classifier_scores"](spark, SF).collect()
    assert scores and all(0 <= r.p <= 1 for r in scores)
    features = [F.lit(1).alias(c) for c in learn.FEATURES[1:]]
    rows = spark.range(400).select((F.col("id") % 40).cast("int").alias("token_count"), *features, (F.col("id") % 40 >= 20).cast("int").alias("label"), F.col("id").alias("extra"))
    model = learn.train(rows, rounds=5)
    right = learn.scored(rows, model).where((F.col("p") > 0.5) == (F.col("label") == 1)).count()
    assert right >= 380
    folder = f"file://{tmp_path}/models"
    assert learn.load(spark, folder) is None
    learn.save(model, folder, 1)
    assert learn.scored(rows, learn.load(spark, folder)).exceptAll(learn.scored(rows, model)).isEmpty()
    assert learn.train(rows.where("label = 1")) is None and learn.scored(rows, None).where("p <> 0").isEmpty()
