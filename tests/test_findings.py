"""What a review found: odd texts and files that the given tables do not hold."""

import duckdb
import pytest

from harrow import file_queries  # noqa: F401  (registers its queries)
from harrow.queries import QUERIES, SQL
from harrow.sources import readers
from tests.oracle import rows

ODD = ["plain", "  lead", "trail  ", "\ttab\t", "\nfirst line empty", "last line empty\n", "cr \r lone", "\r\ncrlf\r\n", 'quo"te', '"', "back\\", "", None, " ", "\n", 'a,"b\nc"', "!!!", "???", "\u00a0nbsp", "nul \x00 in", "é"]


@pytest.mark.parametrize("name", ["csv_round_trip", "duplicate_group_ids"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    docs = [(i, t, "en" if i % 3 else " fr", "s" if i % 4 else None, len(t or "")) for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("encoding", ["utf-8", "cp1254", "iso-8859-9"])
def test_encoding_of_files_whose_first_is_a_header_alone(spark, tmp_path, encoding):
    (tmp_path / "part-0.csv").write_bytes(b"x;y\n")
    (tmp_path / "part-1.csv").write_bytes(b"x;y\n" + b"plain;1\n" * 300_000 + "şık é;2\n".encode(encoding) + (b"\x81;3\n" if encoding == "iso-8859-9" else b""))
    assert readers.encoding_of(spark, str(tmp_path)) in (encoding, encoding + "-sig")
    assert readers.read_csv_flexible(spark, str(tmp_path)).where("y = 2").first()["x"] == "şık é"


def test_gram_pairs_are_all_given(spark):
    from harrow.operators import similarity
    from tests.test_operators import brute_cosine

    words = "haber metin olay kent gazete sabah akşam deniz kara hava yol köprü liman ova dağ".split()
    base = " ".join(words * 2)
    texts = {f"{i:02}": f"{base} {w} {words[i % 7]}{i}" for i, w in enumerate(words)} | {"a0": "kısa bir metin", "a1": "kısa bir metin"}
    rows_ = similarity.gram_pairs(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", copies=True).collect()
    near = {(r["record_id_left"], r["record_id_right"]) for r in rows_ if r["relation"] == "near"}
    assert near == brute_cosine(texts, 0.85) and len(near) > 8 * len(words) / 2
    assert [(r["record_id_left"], r["record_id_right"]) for r in rows_ if r["relation"] == "copy"] == [("a0", "a1")]


def test_gram_pairs_between_blocks_and_against_few_agree(spark, monkeypatch):
    from harrow.operators import similarity

    left = [(str(i), f"the old bridge number {i % 9} of the river town stands on {i % 4} arches of stone and iron") for i in range(40)]
    right = [(str(i), f"the old bridge number {i} of the river town stands on 3 arches of stone and iron") for i in range(9)]
    a, b = (spark.createDataFrame(x, "id string, t string") for x in (left, right))
    few = {tuple(r) for r in similarity.gram_pairs(a, "id", "t", other=b, exact=True).collect()}
    monkeypatch.setattr(similarity, "FEW_ROWS", 0)
    assert few and few == {tuple(r) for r in similarity.gram_pairs(a, "id", "t", other=b, exact=True).collect()}


def test_vocabulary_of_equal_counts_goes_by_term(spark):
    from harrow.operators import models

    df = spark.createDataFrame([(i, "delta alpha charlie bravo") for i in range(3)] + [(9, "zulu zulu")], "id long, text string")
    assert models.TermWeights(least_df=2, most_df=1.0, features=3, lengths=(1,)).fit(df, "text").counts.vocabulary == ["alpha", "bravo", "charlie"]


def test_texts_in_slices_keep_their_order_and_nulls():
    import pyarrow as pa

    from harrow.functions.normalize import SLICE, in_slices

    texts = [None if i % 7 == 0 else f"t{i}" for i in range(3 * SLICE + 5)]
    assert in_slices(pa.array(texts, pa.string()), str.upper, pa.string()).to_pylist() == [t and t.upper() for t in texts]
    assert len(in_slices(pa.array([], pa.string()), str.upper, pa.string())) == 0
