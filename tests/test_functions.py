"""Micro-fixtures of the column functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from harrow.functions import edits, measures, normalize, pages, records
from harrow.functions.hashing import bands, feature_hash, hamming, hex64, shingles
from harrow.functions.masks import destyle


def one(spark, expression, **columns):
    """The value of an expression over one row."""
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expression.alias("x")).first()["x"]


def test_service_cleaner(spark):
    value = one(spark, normalize.service("t"), t="  Haber​   metni\n\n düzenli biçimde temizlendi.  ")
    assert value["text"] == "Haber metni düzenli biçimde temizlendi." and value["status"] == "ok"
    for text, status in ((None, "not_text"), ("", "empty"), ("çok kısa", "too_short"), ("x" * 100_001, "too_long")):
        assert one(spark, normalize.service("t"), t=text)["status"] == status


def test_normalizers(spark):
    assert one(spark, normalize.plain_spaces("t"), t="﻿a  b​c ﬁ") == "a bc fi"
    assert one(spark, normalize.visible("t", newlines=True), t=" a⁦b\r\nc ") == "ab\nc"
    assert one(spark, normalize.lines("t"), t="a \t b\n\n\n c\n") == "a b\nc"
    assert one(spark, normalize.key_numbers("t"), t="<URL> On 12.05.2020, 3,5 Kg!") == "on numtoken numtoken kg"
    assert one(spark, normalize.key_turkish("t"), t="İDDİA / Foto: ISPARTA'da İş") == "ısparta da iş"
    assert one(spark, normalize.clean_claim("t"), t="İDDİA / VİDEO: - Dünya düz") == "Dünya düz"
    assert one(spark, normalize.key_ascii("t"), t="Anadolu AJANSI é") == "anadolu ajansi e"
    assert one(spark, normalize.article("t"), t="<p>a&amp;b</p><script>x</script> https://x.y z@q.com") == "a&b <URL> <EMAIL>"
    assert one(spark, normalize.key_letters("t", urls=True), t="Straße www.a.b Ç") == "strasse <url> ç"
    assert one(spark, normalize.key_claim("t"), t="teyit.org @ali yazdı: https://a.b X") == "yazdı x"


def test_masking_in_rule_order(spark):
    text = "ANKARA (AA) - Haber https://a.b c@d.com @user #tag AA muhabirine 5 bin beğeni, teyit.org"
    df = spark.createDataFrame([(text,)], "text string")
    tweets = destyle(df, "text", "mide22").first()
    assert "<USER>" in tweets["text_masked"] and " tag " in tweets["text_masked"] and tweets["mention_masked"] == 1
    claims = destyle(df, "text", "fctr").first()
    assert "@user" in claims["text_masked"] and "<EMAIL>" in claims["text_masked"] and claims["agency_signature_removed"] == 1 and "muhabire" in claims["text_masked"] and "<SOURCE>" in claims["text_masked"]
    styled = destyle(spark.createDataFrame([("Sosyal medyada yayılan bir video iddia edildi.\nAnaliz: x",)], "text string"), "text", "fctr").first()
    assert styled["text_destyled"] == "sosyal medyadaki bir video iddia olarak aktarıldı.\nx"


def test_low_information(spark):
    why = one(spark, measures.low_information("t", "mide22"), t="<USER> <URL>")
    assert why == ["too_few_meaningful_tokens", "placeholder_dominated", "reference_or_link_only", "no_alphabetic_content"]
    assert "generic_claim_phrase" in one(spark, measures.low_information("t", "fctr"), t="Doğru değil!")


@pytest.mark.parametrize(("n", "refused"), [(79, True), (80, False), (3000, False), (3001, True)])
def test_quality_bounds(spark, n, refused):
    why = one(spark, measures.quality_rejections("t", F.lit(n), F.lit(0.9), F.lit(0.9)), t="x")
    assert bool(why) == refused


def test_claims_and_news(spark):
    got = one(spark, records.extracted_claim("t"), t="Claim line.\nBulgular: şu")
    assert (got["claim"], got["method"]) == ("Claim line.", "before_report_heading_first_line")
    got = one(spark, records.extracted_claim("t"), t="Kısa\nikinci satır @ali #etiket")
    assert (got["claim"], got["method"]) == ("Kısa ikinci satır <USER> etiket", "first_text_section_first_two_lines")
    long = "Birinci cümle. " * 60
    assert len(one(spark, records.shortened(F.col("t")), t=long)) <= 600
    item = one(spark, records.news_item("t"), t="\n Başlık \n\nGövde satırı\nKaynak: Hürriyet\n")
    assert (item["title_raw"], item["source"], item["text_basic"]) == ("Başlık", "Hürriyet", "Başlık Gövde satırı")
    assert one(spark, records.news_item("t"), t="")["quality_status"] == "review_required"


def test_addresses(spark):
    assert one(spark, records.canonical_url("t"), t="https://www.X.com/a/?q=1#f") == "x.com/a"
    assert one(spark, records.domain("t"), t="WWW.Haber.com/x") == "haber.com"
    assert one(spark, records.domain("t"), t=None) == "unknown"
    cases = {"https://a.com/": "home_page", "https://a.com/arama/x": "list_page", "https://a.com/gundem/": "list_page", "https://a.com/x?q=a": "search_results", "https://a.com/gundem/haber-1": None, "https://tr.wikipedia.org/wiki/X": "wiki_page", "ftp://a.com/x": "unsupported_scheme"}
    for url, why in cases.items():
        assert one(spark, pages.exclusion("t"), t=url) == why


def test_hashes(spark):
    import zlib

    value = one(spark, feature_hash(F.col("t")), t="bir iki üç")
    raw = "bir iki üç".encode()
    assert value & (2**64 - 1) == zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)
    words = F.array(*[F.lit(str(i)) for i in range(100)])
    grams = one(spark, shingles(words), t="")
    assert len(grams) == 64 and grams[0] == "0 1 2" and grams[-1] == "97 98 99"
    assert one(spark, hex64(F.lit(-1).cast("long")), t="") == "f" * 16
    assert one(spark, hamming(F.lit(5).cast("long"), F.lit(6).cast("long")), t="") == 2
    assert one(spark, bands(F.lit(1).cast("long")), t="") == [1, 65536, 131072, 196608]


def test_simhash_is_the_majority_of_bits(spark):
    import zlib

    from harrow.operators.similarity import with_simhash

    text = "bir iki üç dört beş altı"
    words = text.split()
    features = [" ".join(words[i : i + 3]).encode() for i in range(4)]
    hashes = [zlib.crc32(f) << 32 | zlib.crc32(f, 0x9E3779B9) for f in features]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= 4)
    got = with_simhash(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t").collect()
    assert got[0]["simhash"] & (2**64 - 1) == want and got[1]["simhash"] == got[2]["simhash"] == 0


def test_edits():
    rng = random.Random(1)
    assert 0 <= float(edits.percentage("faiz yüzde 50 oldu", rng)[3]) <= 100
    text, kind, before, after, _ = edits.date("28 Mart 2020", random.Random(0))
    assert kind == "date_change" and before == "28 Mart 2020" and 1 <= int(after.split()[0]) <= 28 and text == after
    assert edits.time("saat 23:15", rng)[3].endswith(":15")
    assert edits.number("1 ve 2020", rng) is None
    assert edits.format_number(0.01, "1,5") == "0,1" and edits.format_number(0.2, "3") == "1"
    once, again = (edits.counterfactual("Ankara'da 35 kişi, yüzde 20", "r1") for _ in range(2))
    assert once == again and once[0] != "Ankara'da 35 kişi, yüzde 20"
    assert edits.counterfactual("hiçbir şey", "r") is None


def test_differences():
    ratio, changed, removed, added, share, kinds, gone, new, near = edits.difference("a b c d", "a x c d e")
    assert (changed, removed, added, kinds, gone, new) == (2, 1, 2, ["replace", "insert"], ["b"], ["x", "e"]) and 0 < ratio < 1 and len(near) == 2
    assert edits.join_tokens(["(", "a", ",", "b", ")", "!"]) == "(a, b)!"


def test_page_acceptance(spark):
    ld = json.dumps({"@graph": [{"@type": "NewsArticle", "author": "x", "datePublished": "2020"}]})
    body = "".join(f"<p>{i} {'kelime ' * 45}</p>" for i in range(6))
    html = f"<html><head><script type='application/ld+json'>{ld}</script></head><body><article><h1>Uzun bir başlık</h1>{body}<p style='display:none'>{'gizli ' * 20}</p></article><footer><p>{'alt ' * 30}</p></footer></body></html>"
    df = spark.createDataFrame([(1, "https://a.com/b/c", html), (2, "https://a.com/", html), (3, "https://a.com/b/c", None)], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.detected_articles(df).collect()}
    assert got[1]["ok"] and got[1]["score"] == 5 + 1 + 2 + 1 + 1 + 2 + 2 + 1 and got[1]["paragraph_count"] == 6 and "gizli" not in got[1]["page"]["text"]
    assert got[2]["reason"] == "home_page" and got[3]["reason"] == "no_title"


def test_match_context_and_preview(spark):
    got = one(spark, measures.match_context("t", "(?i)key", 3), t="aaaa KEY bbbb")
    assert got["match"] == "KEY" and got["context"] == "... aa KEY bb ..."
    assert one(spark, measures.preview("t", 3), t="ab  cd") == "ab ..."


def test_labels(spark):
    assert one(spark, records.label_number("t"), t=" Fake ") == 1
    assert one(spark, records.truth("t"), t="Evet") is True and one(spark, records.truth("t"), t=None) is False
    assert one(spark, records.is_false_label("t"), t="YANLIŞ") is True
    with pytest.raises(Exception, match="unknown label"):
        one(spark, records.label_number("t"), t="?")
    assert one(spark, records.date_only("t"), t="2020-03-01 10:00:00") == "2020-03-01" and one(spark, records.date_only("t"), t="x") is None
