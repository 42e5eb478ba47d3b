"""Queries over files: a table is written by the library's writers, and what its readers read back is compared with the table.

The files are in the session's shared folder and go at the end of the process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import normalize as N
from harrow.operators import models, reports
from harrow.plans import corpus, training
from harrow.queries import KEY_C, articles, query, read, texts
from harrow.sources import readers, writers
from harrow.staging import scratch

TEXT = "md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)))"


def text_digest(column: str = "text"):
    """A digest that line ends, which files of lines may alter, do not change."""
    return F.md5(N.sub(F.coalesce(F.col(column), F.lit("")), "\r\n|\r", "\n").cast("binary"))


@query(f"SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TEXT} AS digest, n_chars FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted texts with commas, quotes and line breaks, typed by a schema."""
    path = scratch(spark, "csv")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    writers.write_csv(docs, path)
    out = readers.read_csv(spark, path, docs.schema)
    return out.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], text_digest().alias("digest"), "n_chars")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, coalesce(l_returnflag, '') AS l_returnflag FROM lineitem")
def csv_of_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text (S02); without quoted line breaks a large file is split."""
    path = scratch(spark, "strings")
    columns = ["l_orderkey", "l_linenumber", "l_returnflag"]
    writers.write_csv(read(spark, sf_dir, "lineitem").select(*columns), path)
    return readers.read_csv_strings(spark, path, columns, line_breaks=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated, types inferred."""
    path = scratch(spark, "tsv")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").write.options(header=True, sep="\t").csv(path)
    return readers.read_tsv(spark, path).withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query("SELECT c_custkey, c_name || ' é' AS c_name, c_mktsegment, c_acctbal FROM customer")
def flexible_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose encoding and separator are found out."""
    path = scratch(spark, "flexible")
    named = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_mktsegment", "c_acctbal")
    named.write.options(header=True, sep=";", encoding="ISO-8859-1").csv(path)
    return readers.read_csv_flexible(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("SELECT r_regionkey, r_name FROM region")
def csv_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is there and one that is not (S06), the first of those that are."""
    path = scratch(spark, "regions")
    region = read(spark, sf_dir, "region")
    writers.write_csv(region, f"{path}/there")
    found = readers.first_existing(spark, [f"{path}/missing", f"{path}/there"])
    return readers.read_csv_or_empty(spark, f"{path}/missing", region.schema).unionByName(readers.read_csv_or_empty(spark, found, region.schema))


@query("SELECT 'region=' || n_regionkey AS category, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(1 AS BIGINT) AS files FROM nation GROUP BY n_regionkey")
def text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in folders, the folder as the category."""
    path = scratch(spark, "tree")
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("value"))
    nation.repartition(1).sortWithinPartitions("region", "value").write.partitionBy("region").text(path)
    tree = readers.read_text_tree(spark, path)
    lines = tree.select("category", F.explode(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " ")).alias("n"))
    files = tree.groupBy("category").agg(F.count("*").alias("files"))
    return lines.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("names")).join(files, "category")


@query("""SELECT sha256('{' || chr(10) || '  "rows": ' || count(*) || chr(10) || '}') AS sha256, 'a/report.json' AS shallowest, 'a/b/large.json' AS largest, CAST(2 AS BIGINT) AS files FROM documents""")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, largest and shallowest of files in folders (S09 to S13), a report as JSON."""
    path = scratch(spark, "files")
    row = read(spark, sf_dir, "documents").agg(F.count("*").alias("rows"))
    writers.write_json(row, f"{path}/a/report.json")
    writers.write_json(row.withColumn("note", F.lit("x" * 100)), f"{path}/a/b/large.json")
    digest = readers.file_digest(spark, f"{path}/a/report.json").select("sha256")
    names = [str(x).split(path.removeprefix("file:").lstrip("/") + "/")[-1] for x in (readers.shallowest_file(spark, path, "*.json"), readers.largest_file(spark, path, "*.json"))]
    return digest.withColumns({"shallowest": F.lit(names[0]), "largest": F.lit(names[1]), "files": F.lit(readers.find_files(spark, path, "*.json").count())})


@query("SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS row_count, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1")
def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each split, read one by one."""
    path = scratch(spark, "splits")
    place = F.pmod("doc_id", F.lit(10))
    docs = read(spark, sf_dir, "documents").withColumn("split", F.when(place < 8, "train").when(place == 8, "validation").otherwise("test"))
    writers.write_splits(docs, path)
    out = None
    for split in training.SHARES:
        part = spark.read.schema(docs.drop("split").schema).parquet(f"{path}/split={split}").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("split").agg(F.count("*").alias("row_count"), F.count_distinct("doc_id").alias("ids"))


@query("SELECT lang AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small report with a byte order mark, for spreadsheets (K01), read without being told its encoding."""
    path = f"{scratch(spark, 'report')}/report.csv"
    writers.write_report_csv(reports.distribution(read(spark, sf_dir, "documents"), "lang"), path)
    return readers.read_csv_flexible(spark, path).select("value", F.col("count").cast("long").alias("count"), F.col("percentage").cast("double").alias("percentage"))


@query("WITH m AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT source)::DOUBLE AS sources FROM documents) UNPIVOT m ON rows, sources INTO NAME metric VALUE value")
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, value) lines as a file."""
    path = f"{scratch(spark, 'metrics')}/metrics.csv"
    writers.write_metrics(read(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources")), path)
    return readers.read_csv_flexible(spark, path).select("metric", F.col("value").cast("double").alias("value"))


@query("SELECT count(*) AS sections, CAST(count(*) + 4 AS BIGINT) AS summary_lines FROM region")
def pages_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of differences and a plain summary."""
    path = scratch(spark, "pages")
    region = read(spark, sf_dir, "region")
    empty = F.array().cast("array<string>")
    writers.write_diff_page(region.select(F.col("r_regionkey").alias("pair_id"), F.array("r_name").alias("removed"), empty.alias("added"), empty.alias("contexts")), f"{path}/page.html", "Regions")
    writers.write_summary(region, f"{path}/summary.txt", "Regions")
    page = readers.read_bytes(spark, f"{path}/page.html").decode()
    summary = readers.read_bytes(spark, f"{path}/summary.txt").decode()
    return spark.createDataFrame([(page.count("<section>"), len(summary.splitlines()))], "sections long, summary_lines long")


@query("SELECT count(*) AS row_count, count(*) AS same FROM labels JOIN documents USING (doc_id)")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model written and read back says the same."""
    from pyspark.ml import PipelineModel

    rows = texts(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    model = models.length_baseline(rows, "text")
    path = scratch(spark, "model")
    writers.write_model(model, path)
    counted = rows.withColumn("_words", models.word_count("text").cast("double"))
    before = model.transform(counted).select("doc_id", F.col("prediction").alias("a"))
    after = PipelineModel.load(path).transform(counted).select("doc_id", F.col("prediction").alias("b"))
    return before.join(after, "doc_id").agg(F.count("*").alias("row_count"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("SELECT doc_id AS record_id, CASE quality WHEN 0 THEN 'fake' ELSE 'real' END AS label FROM labels")
def labelled_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set under the library's names (S15, without the download)."""
    out = readers.labelled_dataset(read(spark, sf_dir, "labels"), {"doc_id": "record_id", "quality": "label"}, {0: "fake", 1: "real"})
    return out.select("record_id", "label")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def input_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in input order."""
    return readers.with_ordinal(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    f"""WITH k AS (SELECT doc_id, source, {KEY_C.replace('âîû<>', '')} AS key FROM (SELECT doc_id, source, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)), g AS (SELECT key, count(*) AS n FROM k GROUP BY key)
 SELECT 'archive_' || source || '_' || doc_id AS record_id, g.n > 1 AS is_exact_duplicate FROM k JOIN g USING (key)"""
)
def archived_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News files parsed, with their exact duplicates marked (E16); a document stands for a file, its source for the folder."""
    docs = texts(spark, sf_dir).where("source is not null and text is not null").select("text", F.col("source").alias("category"), F.col("doc_id").cast("string").alias("name"))
    return corpus.archive(docs).select("record_id", "is_exact_duplicate")


@query()
def near_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine pairs within two sets of short texts and across them."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), N.key_lower("text").alias("t"))
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), N.key_lower("text").alias("t"))
    return corpus.near_duplicate_audit({"items": items, "turns": turns}, "id", "t", [("turns", "items")])


@query()
def external_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim baselines with a test set from elsewhere, whose texts the training set must not hold (E24); here the texts of other languages."""
    rows = articles(spark, sf_dir).where("label_standard is not null").select("doc_id", "text", F.col("dataset_name").alias("lang"), (F.col("label_standard") == "fake").cast("int").alias("label"))
    return training.external_baselines(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), "doc_id")
