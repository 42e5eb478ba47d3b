"""Contracts and invariants of the operators and pipelines."""

import pytest
from pyspark.sql import functions as F

from harrow.operators import chunks, dedup, metrics, pairs, ranking, reports, schema, similarity
from harrow.operators.components import components
from harrow.plans import corpus, evaluation, training
from harrow.sources import readers, writers


def test_schema_helpers(spark):
    df = spark.createDataFrame([("a", "uzun metin burada", 1)], "`Başlık` string, `Haber Gövdesi` string, id int")
    with pytest.raises(ValueError, match="x"):
        schema.require_columns(df, ["id", "x"])
    assert schema.find_column(df.columns, ["baslik"]) == "Başlık" and schema.find_column(df.columns, ["govde"]) is None
    assert schema.find_column(df.columns, ["govde"], partial=True) == "Haber Gövdesi" and schema.longest_text_column(df) == "Haber Gövdesi"
    with pytest.raises(ValueError, match="label"):
        schema.check_domain(spark.createDataFrame([("z",)], "label string"), "label", ["real"])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (9, 9), (None, 1)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).select("component").distinct().count() == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_in_random_order(spark):
    chain = spark.range(400).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    got = components(chain).agg(F.count("*").alias("n"), F.count_distinct("component").alias("pieces"), F.min("component").alias("c"), F.min("id").alias("least")).first()
    assert got["n"] == 401 and got["pieces"] == 1 and got["c"] == got["least"]


def test_hash_ranks_are_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"))
    ranked = ranking.with_hash_rank(df, ranking.seeded("id"), ["s"], "r", "n", ties=["id"])
    for row in ranked.groupBy("s").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count_distinct("r").alias("d"), F.first("n").alias("n")).collect():
        assert row["a"] == 1 and row["b"] == row["d"] == row["n"]


def test_group_split_keeps_groups_and_shares(spark):
    df = spark.range(600).select("id", F.floor(F.col("id") / 3).alias("g"), (F.floor(F.col("id") / 3) % 2).alias("label"))
    split = ranking.group_split(df, "g", "label", training.SHARES)
    assert ranking.split_leaks(split, "g").count() == 0 and split.count() == 600
    sizes = {(r["label"], r["split"]): r["n"] for r in split.groupBy("label", "split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {(label, s): n for label in (0, 1) for s, n in (("train", 80), ("validation", 10), ("test", 10))}
    again = ranking.group_split(df, "g", "label", training.SHARES)
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_capped_selection_refills(spark):
    df = spark.range(20).select("id", F.when(F.col("id") < 15, "a").otherwise("b").alias("source"))
    got = ranking.capped_selection(df, [F.col("id")], 3, 10, 8, "source", "id").collect()
    assert len(got) == 8 and {r["id"] for r in got} == {0, 1, 2, 15, 16, 17, 3, 4}


def test_representatives(spark):
    rows = [("r1", "h", "c", "unknown", 10, "quality_candidate"), ("r2", "h", "c", "known", 10, "quality_candidate"), ("r3", "h", "c", "known", 99, "review_required"), ("r4", "i", "c", "x", 1, "quality_candidate")]
    df = spark.createDataFrame(rows, "record_id string, exact_text_hash string, category_original string, source string, word_count int, quality_status string")
    got = {r["record_id"]: r["deduplication_action"] for r in dedup.choose_representatives(df).collect()}
    assert got == {"r1": "exclude_exact_duplicate", "r2": "keep_exact_group_representative", "r3": "exclude_exact_duplicate", "r4": "keep_unique"}


def test_simhash_greedy(spark):
    base = [f"kelime{i}" for i in range(200)]
    edit = [*base[:100], "baska", *base[101:]]
    texts = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edit)), (4, " ".join(base[:150])), (5, None), (6, "")]
    got = {r["record_id"]: r["representative_record_id"] for r in similarity.simhash_duplicates(spark.createDataFrame(texts, "id long, t string"), "id", "t", "id").collect()}
    assert got[2] == 1 and 4 not in got and 5 not in got and 6 not in got and got.get(3, 1) == 1


def test_greedy_is_not_transitive(spark):
    links = spark.createDataFrame([(1, 2, 1, 1.0), (2, 3, 1, 1.0), (3, 4, 1, 1.0)], "earlier long, later long, hamming_distance int, length_ratio double")
    assert {(r["id"], r["representative"]) for r in similarity.greedy_representatives(links).collect()} == {(2, 1), (4, 3)}


@pytest.mark.parametrize("few", [similarity.FEW_LINKS, 990])
def test_greedy_settles_a_long_chain(spark, few):
    links = spark.range(1, 1001).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"), F.lit(1).alias("hamming_distance"), F.lit(1.0).alias("length_ratio"))
    got = {(r["id"], r["representative"]) for r in similarity.greedy_representatives(links, few).collect()}
    assert got == {(i, i - 1) for i in range(2, 1001, 2)}
    with pytest.raises(ValueError, match="earlier"):
        similarity.greedy_representatives(links.limit(0).unionByName(links.selectExpr("earlier", "1 later", "hamming_distance", "length_ratio")))


def brute_cosine(texts, threshold):
    import math
    from collections import Counter

    def grams(t):
        for w in t.lower().split():
            p = f" {w} "
            for n in (3, 4, 5):
                if len(p) <= n:
                    yield p
                    if len(p) < n or n == 3:
                        break
                else:
                    yield from (p[i : i + n] for i in range(len(p) - n + 1))

    tf = {i: Counter(grams(t)) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    vec = {i: {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(w * w for w in v.values())) or 1 for i, v in vec.items()}
    return {(a, b) for a in vec for b in vec if a < b and texts[a] != texts[b] and sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) / norm[a] / norm[b] >= threshold}


def test_benchmark_nearest_looks_into_documents(spark, tmp_path):
    from harrow.queries import benchmark_nearest

    item = "the capital of the old kingdom lies on a river between two hills and has seven stone bridges"
    spark.createDataFrame([(1, item + " today"), (2, "nothing of the kind")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r["record_id_left"], r["record_id_right"]) for r in benchmark_nearest(spark, str(tmp_path)).collect()] == [("1", "7")]


def test_gram_pairs_match_brute_force(spark):
    words = "haber metin olay kent gazete sabah akşam deniz kara hava yol köprü".split()
    texts = {str(i): " ".join(words[(i * k) % 12] for k in range(1, 12)) for i in range(1, 9)}
    texts |= {"a": texts["1"] + " ek", "b": texts["2"].replace("deniz", "denizi")}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {tuple(sorted((r["record_id_left"], r["record_id_right"]))) for r in similarity.gram_pairs(df, "id", "t", neighbours=100).collect()}
    assert got == brute_cosine(texts, 0.85)


def test_windows(spark):
    for n, k in ((80, 1), (510, 1), (511, 2), (1518, 4)):
        w = spark.range(1).select(chunks.windows(F.lit(n)).alias("w")).first()["w"]
        assert len(w) == k and sum(x["effective_token_count"] for x in w) == n and w[-1]["end"] == n and all(x["token_count"] <= 510 for x in w)


def test_combined(spark):
    df = spark.createDataFrame([(1, 0.9, 510), (1, 0.2, 100)], "d int, fake_probability double, effective_token_count int")
    row = chunks.combined(df, "d").first()
    assert row["fake_probability"] == round((0.9 * 510 + 0.2 * 100) / 610, 6) and row["label"] == "fake" and abs(row["fake_probability"] + row["real_probability"] - 1) < 2e-5


def test_metrics(spark):
    ties = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "pair_id int, true_label int, fake_probability double")
    assert metrics.pair_ranking(ties).first()["correct_pairs"] == 0
    assert metrics.roc_auc(ties.where("true_label = 1"), "true_label", "fake_probability").first()["roc_auc"] is None
    four = spark.createDataFrame([(0, 0, 0.95), (1, 1, 0.9), (1, 0, 0.6), (0, 1, 0.92)], "true_label int, predicted_label int, confidence double")
    got = {r["threshold"]: r for r in metrics.threshold_table(four, thresholds=(0.5, 0.9)).collect()}
    assert got[0.5]["coverage"] == 1.0 and got[0.9]["accepted_count"] == 3 and got[0.9]["errors_caught"] == 1 and got[0.9]["selective_accuracy"] == round(2 / 3, 6)


def test_pair_audit(spark):
    schema_ = "record_id string, pair_id string, split_group_id string, parent_record_id string, label_standard string, text_basic string, is_synthetic boolean, edit_type string, original_fact string, modified_fact string"
    long = "bir iki üç dört beş altı yedi sekiz dokuz on " * 5
    rows = [
        ("a", "p", "p", "", "real", long + "35 kişi", False, "", "", ""), ("b", "p", "p", "a", "fake", long + "70 kişi", True, "number_change", "35", "70"),
        ("c", "q", "q", "", "real", "x", False, "", "", ""), ("d", "r", "r", "", "real", "ayni", False, "", "", ""), ("e", "r", "r", "z", "fake", "ayni", True, "k", "1", "1"),
    ]
    got = {r["pair_id"]: r for r in pairs.audited_pairs(spark.createDataFrame(rows, schema_)).collect()}
    assert got["p"]["quality_status"] == "accepted_auto" and got["p"]["changed_token_count"] == 1
    assert got["q"]["quality_reasons"] == "pair_record_count_not_two;fake_record_count_not_one"
    assert got["r"]["quality_status"] == "rejected" and "real_and_fake_identical" in got["r"]["quality_reasons"]


def test_training_set_invariants(spark):
    real = spark.range(50).select(F.col("id").alias("pair_id"), F.concat(F.lit("gerçek "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    fake = spark.range(2, 55).select(F.col("id").alias("pair_id"), F.concat(F.lit("sahte "), F.col("id").cast("string")).alias("text"), F.lit("m").alias("method"))
    rows, unmatched = training.paired_training_set(real, fake, "pair_id", "text")
    assert training.check_pairs(rows).count() == 96 and unmatched.count() == 5
    with pytest.raises(ValueError, match="pairs"):
        training.check_pairs(rows.where("label = 'real'"))


def test_duplicate_groups_number_in_record_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], "id long, key string")
    links = spark.createDataFrame([(4, 2)], "a long, b long")
    got = {r["id"]: r["split_group_id"] for r in training.duplicate_groups(df, "id", "key", links).collect()}
    assert got == {1: "group_000001", 3: "group_000001", 2: "group_000002", 5: "group_000002", 4: "group_000002"}


def test_unify_and_audit(spark):
    df = spark.createDataFrame([(2, "B", "gövde iki", "fake"), (1, "A", "gövde bir", "real")], "n int, t string, c string, l string")
    out = corpus.unified(df, "d", "task", "article", "t", "c", "l", None, None, None, "n", "rec")
    assert [r["record_id"] for r in out.orderBy("record_id").collect()] == ["rec_000001", "rec_000002"] and out.orderBy("record_id").first()["title_raw"] == "A"
    assert corpus.unified_audit({"x": out}).first()["row_count"] == 2
    with pytest.raises(ValueError, match="collide"):
        corpus.unified_audit({"x": out, "y": out})


def test_clean_pool_keeps_the_first_good(spark):
    good = " ".join(f"kelime{i}" for i in range(100))
    df = spark.createDataFrame([(1, "kısa"), (2, good), (3, good.upper()), (4, None)], "id long, t string")
    accepted, rejected = corpus.clean_pool(df, "t", "id", columns=["id"])
    assert [r["id"] for r in accepted.collect()] == [2]
    assert {r["id"]: r["rejection_reasons"] for r in rejected.collect()} == {1: "below_minimum_word_count", 3: "exact_duplicate", 4: "empty_text"}


def test_verification_and_prediction_join(spark):
    p = spark.createDataFrame([(0, 1, 1, 0.9), (1, 0, 0, 0.1)], "original_index int, true_label int, predicted_label int, s double")
    got = {r["metric"]: r["within_tolerance"] for r in evaluation.verification(p, "true_label", "predicted_label", "s", {"accuracy": 1.0, "roc_auc": 0.5}).collect()}
    assert got == {"accuracy": True, "roc_auc": False}
    with pytest.raises(ValueError, match="match"):
        evaluation.joined_predictions(p, p.where("original_index = 0").select("original_index"))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('x;y\n"çok\n""iyi""";1\n'.encode("cp1254"))
    row = readers.read_csv_flexible(spark, str(tmp_path / "a.csv")).first()
    assert row["x"] == 'çok\n"iyi"' and row["y"] == 1
    (tmp_path / "news" / "spor").mkdir(parents=True)
    (tmp_path / "news" / "spor" / "1.txt").write_bytes("Başlık".encode("cp1254"))
    item = readers.read_text_tree(spark, str(tmp_path / "news")).first()
    assert (item["category"], item["name"], item["text"]) == ("spor", "1", "Başlık")
    assert readers.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "x string").count() == 0
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    writers.write_report_csv(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v")
    writers.write_json(df, str(tmp_path / "r.json"))
    writers.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first()["split"] == "train"


def test_reports(spark):
    df = spark.createDataFrame([("a;b",), ("a",), ("",), (None,)], "r string")
    assert {x["reason"]: x["count"] for x in reports.reason_distribution(df, "r").collect()} == {"a": 2, "b": 1}
    assert reports.column_profile(df).first()["empty_count"] == 2
    empty = df.limit(0)
    assert reports.distribution(empty, "r").count() == 0 and reports.column_profile(empty).first()["non_empty_percentage"] == 0


def test_stream_keeps_each_text_once(spark, tmp_path):
    from harrow.streaming.incremental import distinct_texts, to_table

    spark.createDataFrame([("Aynı metin",), ("aynı METİN".replace("İ", "i"),), ("başka",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    to_table(distinct_texts(stream, "text"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
