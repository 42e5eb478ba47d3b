"""Queries that SQL cannot express, against plain Python over the same tables."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from difflib import SequenceMatcher
from urllib.parse import unquote, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.functions import constants as K
from harrow.functions import pages as P
from harrow.functions.masks import MASK_COUNTERS, mask_rules, restyle_rules
from harrow.operators import dedup, models
from harrow.queries import QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = K.TURKISH_LETTERS
WHITE = "[\t-\r \x85\xa0  -     　]"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain(pattern):
    """A pattern of the library for Python, whose classes are Unicode's already."""
    return re.sub(r"\(\?([imsU]+)\)", lambda m: (f"(?{m[1].replace('U', '')})" if m[1] != "U" else ""), pattern)


def folded(text):
    out = unicodedata.normalize("NFKC", text or "").lower().replace("ß", "ss")
    return "".join(c for c in out if unicodedata.category(c) != "Cf")


def squeezed(text):
    return re.sub(f"{WHITE}+", " ", text).strip(" ")


def key_letters(text):
    return re.sub("[^0-9a-zçğıöşüâîû<>]+", " ", folded(text)).strip(" ")


def simhash(text):
    words = re.findall(f"[0-9{LETTERS}]+", folded(text))
    n = len(words) - 2
    at = range(max(n, 0)) if n <= 64 else [n - 1 if i == 63 else int(i * ((n - 1) / 63)) for i in range(64)]
    grams = [" ".join(words[i : i + 3]) for i in at] if n >= 1 else words
    hashes = [zlib.crc32(g.encode()) << 32 | zlib.crc32(g.encode(), 0x9E3779B9) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) >= len(hashes)), len(words)


def greedy(rows):
    """{id: representative} of (id, hash, words) in order: an earlier row that is not covered, near, and of a shared band."""
    heads, out = [], {}
    for i, h, n in rows:
        near = []
        for j, g, m in heads:
            ratio = min(n, m) / max(n, m) if max(n, m) else 0.0
            if (h ^ g).bit_count() <= 5 and ratio >= 0.78 and any((h >> 16 * b & 0xFFFF) == (g >> 16 * b & 0xFFFF) for b in range(4)):
                near.append(((h ^ g).bit_count(), -ratio, j))
        if near:
            out[i] = min(near)[2]
        else:
            heads.append((i, h, n))
    return out


def test_simhash_values(spark, texts):
    got = {r["doc_id"]: (int(r["simhash64_hex"], 16), r["word_count"]) for r in QUERIES["simhash_values"](spark, SF).collect()}
    assert got == {i: simhash(t) for i, t in texts.items()}


def test_simhash_near_duplicates(spark, texts):
    got = {r["record_id"]: r["representative_record_id"] for r in QUERIES["simhash_near_duplicates"](spark, SF).collect()}
    want = greedy([(i, *simhash(texts[i])) for i in sorted(texts)])
    assert got == want and len(got) >= 5


def test_final_pool_is_the_clean_pool_without_near_duplicates(spark):
    from harrow.plans import corpus

    accepted, rejected = corpus.clean_pool(spark.read.parquet(f"{SF}/documents.parquet"), "text", "doc_id", columns=["doc_id"])
    rows = sorted((r["_at"], r["text_basic"]) for r in accepted.select("_at", "text_basic").collect())
    dropped = greedy([(i, *simhash(t)) for i, t in rows])
    kept = [i for i, _ in rows if i not in dropped]
    got = {r["record_id"]: r["final_pair_id"] for r in QUERIES["final_pool_records"](spark, SF).collect()}
    assert got == {i: f"pair_{n:07d}" for n, i in enumerate(kept, 1)} and len(rows) + rejected.count() == 200


def test_blake2b_hashes(spark, texts):
    for r in QUERIES["blake2b_hashes"](spark, SF).collect():
        assert r["exact_hash"] == hashlib.blake2b(key_letters(texts[r["doc_id"]]).encode(), digest_size=16).hexdigest()
        assert int(r["rank"]) == int.from_bytes(hashlib.blake2b(str(r["doc_id"]).encode(), digest_size=8).digest(), "big")


def test_destyling_audit(spark, texts):
    for r in QUERIES["destyling_audit"](spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        out, changes = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf"), 0

        def lines(t):
            return re.sub(r"\n{3,}", "\n\n", re.sub(f"{WHITE}*\n{WHITE}*", "\n", re.sub(r"[ \t]+", " ", t))).strip()

        for _, pattern, to in mask_rules("mide22"):
            out, n = re.subn(plain(pattern), to.replace("$1", r"\1"), out)
            changes += n
        masked = out = lines(out)
        assert not restyle_rules("mide22") and r["destyle_change_count"] == changes
        assert (r["length_before"], r["length_after"]) == (len(text), len(out)) and r["unchanged"] == (text == out) and r["masked_equals_destyled"] == (masked == out)
        assert r["url_count"] == out.count("<URL>") and r["email_count"] == out.count("<EMAIL>") and r["user_count"] == out.count("<USER>")


#: text, counter that must have counted, what must be in the masked or de-styled text, what must not
RULES = [
    ("Bakınız https://ornek.com/a?b=1 ve www.ornek.com", "url_masked", "<URL>", "ornek"), ("Yazın bana: ad.soyad@ornek.com.tr lütfen", "email_masked", "<EMAIL>", "@"), ("@biri ve @oteki yazdı", "mention_masked", "<USER>", "@biri"), ("Bu #gündem oldu", "hashtag_normalized", "gündem", "#"),
    ("Haberi Anadolu Ajansı duyurdu.", "source_brand_masked", "<SOURCE>", "Anadolu Ajansı"), ("ANKARA (AA) - Kent merkezinde toplantı yapıldı.", "agency_signature_removed", "toplantı", "(AA)"),
    ("AA muhabirinin edindiği bilgiye göre yağmur yağdı.", "reporter_phrase_normalized", "muhabirin", "AA"),
]


@pytest.mark.parametrize(("text", "counter", "there", "gone"), RULES)
def test_mask_rules_act_on_turkish_texts(spark, text, counter, there, gone):
    from harrow.functions.masks import destyle

    row = destyle(spark.createDataFrame([(text,)], "text string"), "text", "mide22").first()
    assert counter in MASK_COUNTERS and row[counter] >= 1 and there in row["text_destyled"] and gone not in row["text_destyled"] and row["destyle_change_count"] >= 1


def test_page_exclusions(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    more = ["https://tr.wikipedia.org/wiki/A", "https://a.com/", "https://a.com", "ftp://a.com/x", "https://a.com/ara?q=1", "https://a.com/x?q=1", "https://a.com/etiket/b", "https://a.com/gundem", "https://a.com/gundem/haber-1", "https://a.com/yazar/ad/yazi", None, "kötü"]

    def reason(url):
        u = urlsplit((url or "").strip())
        if not u.hostname:
            return "unreadable_address"
        if u.scheme not in ("http", "https"):
            return "unsupported_scheme"
        path = unquote(u.path) or "/"
        if re.search(r"(^|\.)(wikipedia|wikimedia|wiktionary|wikiquote|wikibooks|wikisource)\.org$", u.hostname):
            return "wiki_page"
        if path == "/":
            return "home_page"
        if any(p.split("=")[0].lower() in P.SEARCH_KEYS for p in u.query.split("&")):
            return "search_results"
        parts = [x.lower() for x in path.split("/")]
        if any(x in P.EXCLUDED_PATHS for x in parts[1:]) or ([x for x in parts if x][:1] in [[r] for r in P.CATEGORY_ROOTS] and len([x for x in parts if x]) == 1):
            return "list_page"
        return None

    assert {r["page_id"]: r["reason"] for r in QUERIES["page_exclusions"](spark, SF).collect()} == {i: reason(u) for i, u in urls.items()}
    got = spark.createDataFrame([(i, u) for i, u in enumerate(more)], "i int, url string").select("i", P.exclusion("url").alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: reason(u) for i, u in enumerate(more)}


def test_page_articles(spark):
    rows = QUERIES["page_articles"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in rows:
        assert r["ok"] == (r["reason"] is None or r["reason"] == "" or r["reason"] == "ok") or not r["ok"]
        if r["ok"]:
            assert r["score"] >= P.LEAST_SCORE and r["paragraph_count"] >= P.LEAST_PARAGRAPHS and r["character_count"] >= P.LEAST_CHARACTERS
    scored = {r["page_id"]: r for r in QUERIES["scored_pages"](spark, SF).collect()}
    assert all((scored[r["page_id"]]["status"] is not None) == r["ok"] for r in rows)


def test_pair_differences(spark):
    from harrow.operators import pairs
    from harrow.plans import training

    token = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")
    made = training.pilot(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", "source")
    wide = {r["pair_id"]: (r["real_text_basic"], r["fake_text_basic"]) for r in pairs.wide_pairs(made, "pair_id", F.col("label_standard"), ["text_basic"]).collect()}
    got = {r["pair_id"]: r for r in QUERIES["pair_differences"](spark, SF).collect()}
    assert set(got) == set(wide) and got
    for pair, (a, b) in wide.items():
        match = SequenceMatcher(None, token.findall(a), token.findall(b), autojunk=False)
        blocks = match.get_matching_blocks()
        changed = sum(max(blocks[i + 1].a - blocks[i].a - blocks[i].size, blocks[i + 1].b - blocks[i].b - blocks[i].size) for i in range(len(blocks) - 1)) + max(blocks[0].a, blocks[0].b)
        assert got[pair]["similarity"] == round(match.ratio(), 6) and got[pair]["changed_tokens"] == changed and a != b


def test_counterfactual_edits_change_one_fact(spark, texts):
    rows = QUERIES["counterfactual_edits"](spark, SF).collect()
    assert rows
    for r in rows:
        if r["edit_type"]:
            assert r["original_fact"] in texts[r["doc_id"]] and r["original_fact"] != r["modified_fact"] and r["original_fact"].replace("\n", " ") in r["edit_context"]
    assert len(QUERIES["counterfactual_audit"](spark, SF).collect()) >= len([r for r in rows if r["edit_type"]]) > 0


def test_extracted_claims(spark):
    rows = [("Bir iddia var ki çok uzun bir cümledir.\nBulgular\nYanlış.", "Bir iddia var ki çok uzun bir cümledir.", "before_report_heading_first_line"), ("Kısa\nikinci satır burada duruyor\nüçüncü", "Kısa ikinci satır burada duruyor", "first_text_section_first_two_lines"), (None, "", "empty_report"), ("  \n ", "", "empty_report"), ("İddia: " + "uzun cümle. " * 80, ("uzun cümle. " * 49 + "uzun cümle."), "first_text_section_first_line")]
    from harrow.functions.records import extracted_claim

    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", extracted_claim("t").alias("c")).orderBy("i").collect()
    for r, (_, claim, method) in zip(got, rows, strict=True):
        assert r["c"]["method"] == method and (r["c"]["claim"] == claim or len(claim) > 500 and claim.startswith(r["c"]["claim"]) and 500 < len(r["c"]["claim"]) <= 600)
    assert QUERIES["extracted_claims"](spark, SF).count() == 200


def test_mined_claims_by_status(spark, tmp_path):
    item = "the capital of the old kingdom lies on a river between two hills and has seven stone bridges"
    turns = [(1, 0, "user", item), (1, 1, "bot", "another claim about rivers and stone walls of the town"), (2, 0, "user", "another claim about rivers and stone walls of the town"), (3, 0, "user", None), (3, 1, "bot", ""), (4, 0, "user", item.replace("seven", "eight"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, item), (8, "something else of no concern here, only words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["record_id"]: r["candidate_status"] for r in QUERIES["mined_claims"](spark, str(tmp_path)).collect()}
    assert got == {1000: "exclude_existing_exact_overlap", 1001: "new_claim_candidate", 2000: "exclude_internal_exact_duplicate", 3000: "review_low_information", 3001: "review_low_information", 4000: "exclude_existing_near_overlap"}


def test_cosine_near_duplicates_and_audit_return_rows(spark, tmp_path):
    a = "a long enough message about bridges, rivers and the seven hills of the capital"
    turns = [(1, 0, "user", a), (2, 0, "user", a + " today"), (3, 0, "user", "nothing in common with it")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, a + " now"), (8, "other words altogether")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from harrow import file_queries  # noqa: F401

    assert [(r["record_id_left"], r["record_id_right"]) for r in QUERIES["cosine_near_duplicates"](spark, str(tmp_path)).collect()] == [("1-0", "2-0")]
    got = Counter((r["pair_scope"], r["record_id_left"], r["record_id_right"]) for r in QUERIES["near_duplicate_audit"](spark, str(tmp_path)).collect())
    assert got == {("within", "1-0", "2-0"): 1, ("cross", "1-0", "b7"): 1, ("cross", "2-0", "b7"): 1}


def test_source_fingerprints_return_rows(spark, tmp_path):
    rows = [(1, "Bulgular: TRT Haber ve Teyit.org yazdı", "tr", "s", 1), (2, "Teyit edildi", "tr", "s", 1), (3, None, "tr", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["label_standard"], r["pattern_name"]): (r["match_count"], r["group_size"]) for r in QUERIES["source_fingerprints"](spark, str(tmp_path)).collect()}
    want = Counter()
    for i, t, *_ in rows:
        for name, p in K.FINGERPRINTS.items():
            want["real" if i == 1 else None, name] += bool(re.search(plain(p), t or ""))
    assert got == {k: (n, 1 if k[0] else 2) for k, n in want.items() if n} and len(got) >= 3


def test_term_weights(spark):
    texts = ["alpha beta beta gamma", "alpha gamma delta", "", "beta beta beta", "alpha x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = models.TermWeights(least_df=1, most_df=1.0, features=1000).fit(df, "text")
    words = [[w for w in t.split() if len(w) > 1] for t in texts]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for w in words]
    seen = Counter(g for gs in grams for g in set(gs))
    for r in weights.transform(df, "text").collect():
        tf = Counter(grams[r["id"]])
        want = {g: (1 + np.log(n)) * (np.log(6 / (1 + seen[g])) + 1) for g, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in want.values()))
        got = {weights.counts.vocabulary[i]: v for i, v in zip(r["features"].indices, r["features"].values, strict=True)}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g] / norm) < 1e-9 for g in got)


def test_external_baselines(spark):
    from harrow.plans import training

    good, bad = "calm report about the town and its river", "shocking secret they never tell you"
    train = spark.createDataFrame([(i, f"{bad if i % 2 else good} number{i}", i % 2) for i in range(80)], "doc_id long, text string, label int")
    external = spark.createDataFrame([(i, f"{bad if i % 2 else good} number{i}", i % 2) for i in range(60, 100)], "doc_id long, text string, label int")
    got = {(r["test_set"], r["model"]): r for r in training.external_baselines(train, external, "doc_id", features=50).collect()}
    assert len(got) == 6 and all(got["external", m]["tn"] + got["external", m]["fp"] + got["external", m]["fn"] + got["external", m]["tp"] == 40 for m in ("tfidf_logistic", "tfidf_svm", "length_only"))
    assert got["external", "tfidf_logistic"]["accuracy"] == 1.0 and got["external", "tfidf_logistic"]["roc_auc"] == 1.0


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_ranked_duplicates_of_hot_keys(spark, hot):
    rows = [(i, None if i % 5 == 0 else f"k{i % 3}" if i % 2 else "hot", (i * 7919) % 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, o long")
    got = {r["id"]: (r["dedup_rank"], r["dedup_group_size"], r["dedup_keep"]) for r in dedup.ranked_duplicates(df, ["k"], [F.col("o").desc(), F.col("id")], hot=hot).collect()}
    groups = {}
    for i, k, o in rows:
        groups.setdefault(k, []).append((-o, i))
    assert got == {i: (n, len(g), n == 1) for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}


def test_numbered_keys_over_many_parts(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    got = dedup.numbered_keys(df, [F.col("k")], None, "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 20_001))
