"""What a review found of queries' growth: the same results by cheaper steps."""

import random
from collections.abc import Iterator
from difflib import SequenceMatcher
from time import perf_counter

import pyarrow as pa
import pytest

from harrow.functions import constants as K
from harrow.functions import normalize as N
from harrow.functions import pages
from harrow.functions import records as R
from harrow.functions.edits import TokenMatcher, difference
from harrow.operators import reports
from harrow.plans import corpus


def test_character_classes_hold_the_same_characters_without_chains_of_ranges(spark):
    compiled = spark._jvm.java.util.regex.Pattern.compile
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    white = r"\t-\r \x85\xA0  -     　"
    plain = {white: N.WHITE, K.TURKISH_LETTERS: N.LETTERS, "0-9" + K.TURKISH_LETTERS: N.WORD_CHARACTERS, "a-z0-9": N.members("a-z0-9"), "0-9a-zçğıöşüâîû<>": N.members("0-9a-zçğıöşüâîû<>")}
    for old, new in plain.items():
        assert "-" not in new.split("[")[0]  # a look-up in Latin-1
        for negated in ("", "^"):
            assert compiled(f"[{negated}{old}]").matcher(every).replaceAll("") == compiled(f"[{negated}{new}]").matcher(every).replaceAll("")


def test_squeezed_texts_are_as_before(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n\t 　\x85é") for _ in range(rng.randrange(40))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.whitespace("t").alias("s")).collect()
    assert all(r["s"] == " ".join("".join(" " if c in N.WHITE_CHARACTERS else c for c in r["t"]).split()) for r in rows)


def test_differences_of_tokens_by_tables_are_those_of_pairs(monkeypatch):
    rng = random.Random(3)
    for few in (-1, 30):
        monkeypatch.setattr(TokenMatcher, "FEW", few)
        for _ in range(400):
            letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
            x = [rng.choice(letters) for _ in range(rng.randrange(60))] * rng.randrange(1, 4)
            y = list(x) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randrange(60))]
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(3)] = [rng.choice(letters + "xyz") for _ in range(rng.randrange(3))]
            assert TokenMatcher(x, y).get_opcodes() == SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def test_a_long_text_of_few_words_is_compared_in_no_quadratic_time():
    rng = random.Random(7)
    words = [rng.choice("abcdefgh") for _ in range(20_000)]
    began = perf_counter()
    assert difference(" ".join(words), " ".join([*words[:7000], "other", *words[7001:]]))[1] == 1
    assert perf_counter() - began < 10  # by pairs of equal tokens: minutes


def test_pages_are_parsed_and_given_back_few_at_once(spark):
    html = [None, "", *(f"<title>A title of page {i}</title><p>{'some words ' * 9}{i}</p>" for i in range(500))]
    parts = list(pages.facts_of(iter([pa.array(html[:400]), pa.array(html[400:])])))
    assert max(map(len, parts)) <= pages.PAGES_AT_ONCE
    wanted = [dict(zip(pages._FIELDS, pages.page_facts(h), strict=True)) for h in html]
    assert [x for p in parts for x in p.to_pylist()] == wanted
    rows = spark.createDataFrame(list(enumerate(html)), "i int, html string").coalesce(1).select("i", pages.page_udf("html").alias("p")).orderBy("i").collect()
    assert [r["p"].asDict() for r in rows] == wanted


@pytest.mark.parametrize("buckets", [1, 8, 1 << 20])
def test_ngrams_are_the_same_however_many_share_a_bucket(spark, monkeypatch, buckets):
    monkeypatch.setattr(reports, "NGRAM_BUCKETS", buckets)
    rng = random.Random(9)
    docs = [(g, " ".join(rng.choice(words) for _ in range(12))) for g, words in (("a", ["one", "two", "three"]), ("b", ["two", "four", "five", "six"])) for _ in range(60)]
    sets = [(g, {" ".join(w[i : i + n]) for w in [t.split()] for n in (1, 2, 3) for i in range(len(w) - n + 1)}) for g, t in docs]
    found = reports.discriminative_ngrams(spark.createDataFrame(docs, "g string, t string"), "g", "t", top=1000).collect()
    wanted = {}
    for g in "ab":
        for x in set().union(*(s for h, s in sets if h == g)):
            mine, all_ = sum(x in s for h, s in sets if h == g), sum(x in s for _, s in sets)
            if 2 <= all_ <= 0.98 * 120 and mine / 60 >= 0.02 and round(mine / 60 - (all_ - mine) / 60, 6) > 0:
                wanted[g, x] = mine
    assert {(r["g"], r["ngram"]): r["group_df"] for r in found} == wanted


def test_threshold_counts_read_the_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    rows = [("x", 30), ("x", 90), (None, 60), (None, 10), ("", 200), ("y", None)]

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "k string, n int").mapInArrow(seen, "k string, n int")
    got = {r["threshold"]: (r["row_count"], r["unique_count"]) for r in reports.threshold_counts(df, "n", unique="k").collect()}
    assert got == {20: (4, 3), 50: (3, 3), 80: (2, 2), 120: (1, 1), 200: (1, 1)} and reads.value == len(rows)


def test_a_text_that_destyling_empties_is_an_error_when_it_is_read(spark, monkeypatch):
    docs = spark.createDataFrame([("plain text",), ("  ",), (None,)], "t string")
    assert [r["text_destyled"] for r in corpus.destyled(docs, "t", "fctr").collect()] == ["plain text", "", ""]
    with pytest.raises(Exception, match="emptied a text"):
        corpus.destyled(spark.createDataFrame([("analiz:",)], "t string"), "t", "fctr").collect()


def test_a_report_is_searched_for_its_heading_no_more_than_its_columns_need(spark):
    docs = spark.createDataFrame([("Kısa\nbir iddia burada\nBulgular\nx",), ("",), (None,), ("bulgular: x",), ("y " * 900,)], "t string")
    out = docs.select(R.extracted_claim("t").alias("c"))
    assert [r["c"]["method"] for r in out.collect()] == ["before_report_heading_first_two_lines", "empty_report", "empty_report", "empty_claim_section", "first_text_section_first_line"]
    assert out.collect()[4]["c"]["claim"] == ("y " * 300).strip()
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_instr") <= 4


def test_ngrams_are_counted_alike_in_any_alphabet_and_in_order_of_length():
    from collections import Counter

    from harrow.operators.grams import _counted, codes_of

    rng = random.Random(2)
    wide = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(rng.randrange(1, 7))) for _ in range(n)) for n in (1500, 1500, 30, 3)]
    rows = [(t, rng.choice([1, 1, 3])) for t in ["", " ", "a", " ab c ", "abc abc abc", "\0x \U0001f600 y", *wide, *("haber metni gün " * k for k in range(200))]]
    df, every = Counter(), Counter()
    for t, m in rows:
        grams = Counter(zip(*(x.tolist() for x in codes_of(t)), strict=True))
        for g, n in grams.items():
            df[g] += m
            every[g] += n * m
    got_df, got_every = Counter(), Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["t", "m"])
    for b in _counted(iter([batch, batch.slice(0, 0)])):
        for hi, lo, n, total in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "df", "all")), strict=True):
            got_df[hi, lo] += n
            got_every[hi, lo] += total
    assert (got_df, got_every) == (df, every)


def test_texts_unlike_every_reference_in_length_are_not_scored_and_texts_are_read_once(spark, tmp_path, monkeypatch):
    from harrow.operators import grams, similarity

    item = "seven stone bridges lead over the river of the old capital"
    rows = [("a", item), ("b", item + " today"), ("c", item * 3), ("d", "seven stone"), ("e", None), ("f", "")]
    spark.createDataFrame(rows, "id string, t string").write.parquet(f"{tmp_path}/t")
    texts, items = spark.read.parquet(f"{tmp_path}/t"), spark.createDataFrame([("r", item)], "id string, t string")
    seen, real = [], grams.against_few
    monkeypatch.setattr(similarity, "against_few", lambda t, few, words, *a: seen.append((few, words, a)) or real(t, few, words, *a))
    found = similarity.nearest_reference(texts, "id", "t", items, short=60, short_threshold=0.9)
    assert f"{tmp_path}/t" not in str(found.inputFiles())  # not read again for lengths
    got = {(r["record_id_left"], r["record_id_right"], r["similarity"]) for r in found.collect()}
    assert ("a", "r", 1.0) in got and {x[0] for x in got} <= {"a", "b"}
    few, words, rest = seen[0]
    assert rest[2] == 0.55  # threshold, neighbours, least_ratio
    long = spark.createDataFrame([("x", item * 9, 9 * len(item), 0), ("y", item, len(item), 0)], "id string, t string, n int, h long")
    monkeypatch.undo()
    assert [r["l"] for r in real(long, few, words, 0.1, 1, 0.55).collect()] == ["y"]
    assert {r["l"] for r in real(long, few, words, 0.1, 1).collect()} == {"x", "y"}


def test_texts_that_meet_in_chunks_are_written_once(spark, monkeypatch):
    from harrow.operators import grams, similarity

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghı") for _ in range(6)) for _ in range(60)]
    texts = {}
    for k in range(240):
        some = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        texts[f"{k:03}a"], texts[f"{k:03}b"] = " ".join(some), " ".join([*some[1:], rng.choice(words)])
    df = spark.createDataFrame([*texts.items(), ("copy", texts["000a"])], "id string, t string")
    whole = {tuple(r) for r in similarity.gram_pairs(df, "id", "t", copies=True).collect()}
    written, real = [], grams.staged
    monkeypatch.setattr(grams, "staged", lambda x, name, *a: (out := real(x, name, *a), written.append(out.count()))[0])
    monkeypatch.setattr(grams, "CHUNK_ROWS", 7)
    assert {tuple(r) for r in similarity.gram_pairs(df, "id", "t", copies=True).collect()} == whole and len(whole) > 100
    assert sum(written) == len(set(texts.values()))  # by blocks that meet in pairs: many times that
    one, other = df.where("id like '%a'"), df.where("id like '%b'")
    across = {tuple(r) for r in similarity.gram_pairs(one, "id", "t", other=other, exact=True).collect()}
    monkeypatch.setattr(similarity, "FEW_ROWS", 0)
    assert {tuple(r) for r in similarity.gram_pairs(one, "id", "t", other=other, exact=True).collect()} == across and len(across) > 50


def test_simhash_and_counts_of_words_in_one_reading_are_those_of_lists(spark):
    from pyspark.sql import functions as F

    from harrow.functions import hashing as H
    from harrow.functions import measures as M
    from harrow.operators import similarity

    rng = random.Random(6)
    letters = "abcABCçğıİöşÜÂß0１ΣςΣ <>-'​\n "
    texts = [None, "", "...", "one", "one two", "a b c", *(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([3, 30, 66, 67, 300]))) for _ in range(150))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("_w", N.word_list("t")).withColumn("_f", H.shingles(F.col("_w")))
    got = similarity.with_simhash(df, "t")
    for r in got.withColumns({"s": H.simhash_of(F.col("_f")), "n": F.size("_w")}).collect():
        assert (r["simhash"], r["word_count"]) == (r["s"], r["n"])
    plan = got.select("simhash")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan
    words = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(f"({M.WORD_PATTERNS['letters_digits']})"), F.lit(1))
    counted = df.select(M.counted_words("t").alias("c"), words.alias("w")).select("c.*", F.size("w").alias("n"), M.share(F.col("c.distinct"), F.col("c.words")).alias("u"), M.unique_word_ratio(F.col("w")).alias("v"))
    assert all(r["words"] == r["n"] and r["u"] == r["v"] for r in counted.collect())


def test_pages_come_to_python_in_batches_that_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from harrow.functions import pages
    from harrow.plans import evaluation

    sizes = f"{tmp_path}/sizes"

    def noted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            with open(sizes, "a") as f:
                f.write(f"{len(b)}\n")
            yield from pages.facts_of(iter([b]))

    monkeypatch.setattr(pages, "page_udf", F.arrow_udf(noted, pages.struct_of(pages.PAGE_SCHEMA)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("https://a.b/c/d").alias("url"), F.lit("<p>text</p>").alias("html")).coalesce(1)
    assert evaluation.scored_pages(df, lambda t: F.lit(0.5)).count() == 300
    read = [int(x) for x in open(sizes)]
    assert sum(read) >= 300 and max(read) <= pages.PAGES_AT_ONCE
    assert spark.conf.get(key) == before


def test_page_articles_too_come_to_python_in_batches_that_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from harrow import queries
    from harrow.functions import pages

    sizes = f"{tmp_path}/sizes"

    def noted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            with open(sizes, "a") as f:
                f.write(f"{len(b)}\n")
            yield from pages.facts_of(iter([b]))

    monkeypatch.setattr(pages, "page_udf", F.arrow_udf(noted, pages.struct_of(pages.PAGE_SCHEMA)))
    spark.range(600).select(F.col("id").alias("page_id"), F.lit("https://a.b/c/d").alias("url"), F.lit("<p>text</p>").alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES["page_articles"](spark, str(tmp_path))
    assert found.count() == 600 and found.count() == 600
    read = [int(x) for x in open(sizes)]
    assert sum(read) == 600 and max(read) <= pages.PAGES_AT_ONCE


def test_memory_of_a_page_grows_no_faster_than_its_depth():
    import tracemalloc

    from harrow.functions.pages import page_facts

    def peak(depth: int) -> int:
        tracemalloc.start()
        page_facts("<article>a" * depth + "<p>" + "text " * 20)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(2000) < 3 * peak(1000)
