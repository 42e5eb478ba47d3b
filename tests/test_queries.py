"""Every query that has SQL gives the same rows; the others run, and ``test_brute`` holds them against plain Python."""

import pytest

from harrow import file_queries  # noqa: F401  (registers its queries)
from harrow.queries import QUERIES, SQL
from tests.oracle import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_queries_without_sql_give_their_rows(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet").count() for n in ("pages", "documents", "conversations")}
    for name in ("destyling_audit", "extracted_claims", "simhash_values", "blake2b_hashes"):
        assert QUERIES[name](spark, SF).count() == tables["documents"], name
    for name in ("page_exclusions", "page_articles", "scored_pages"):
        assert QUERIES[name](spark, SF).count() == tables["pages"], name
    assert QUERIES["mined_claims"](spark, SF).count() == tables["conversations"]


def test_tfidf_baselines_score_the_same_rows(spark):
    rows = {r["model"]: r for r in QUERIES["tfidf_baselines"](spark, SF).collect()}
    assert set(rows) == {"tfidf_logistic", "tfidf_svm", "length_only"} and len({r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in rows.values()}) == 1
    assert all(0 <= r["accuracy"] <= 1 for r in rows.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "exact_group_id"
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_tfidf_baselines_use_the_whole_vocabulary(spark, monkeypatch):
    from harrow import queries
    from harrow.plans import training

    given, whole = {}, training.baselines.__defaults__[-1]
    monkeypatch.setattr(training, "baselines", lambda train, test, **options: given.update(options) or train)
    queries.QUERIES["tfidf_baselines"](spark, "/root/testdata/sf0.001")
    assert given.get("features", whole) == whole == 100_000
