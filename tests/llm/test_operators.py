"""The training-data operators against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow.llm import chat, chosenpath, codec, html, lattice, mixing, packing, registry, suffix, tokenfiles, tokens, topk, toxicity
from tests.oracle import connection, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty cells, repeated rows and ties, odd characters, very long texts.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "kein Name", "de", None, 9), (3, "é" * 300, "fr", "b", 300), (4, "x " * 5000, "en", "b", 10000), (4, "x " * 5000, "en", "b", 10000),
    (5, "the quick brown fox jumps over the lazy dog " * 8, "en", "c", 1), (6, "the quick brown fox jumps over the lazy dog " * 8, "en", "c", 1), (7, "<|endoftext|> \x1c²½ ﬁ İ ẞ 日本", "xx", "a", 1), (8, "ab", "en", "c", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    """The same rows with columns that are named like the operators' own."""
    return odd.withColumns({c: F.lit(7) for c in ("size", "target", "copies", "_row", "_blk", "_key", "rep", "kept", "start", "score", "word")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- 1 suffix array ------------------------------------------------------------------------------------


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_is_perfect():
    assert len({(a - b) % suffix.V for a in suffix.COVER for b in suffix.COVER}) == suffix.V


def test_suffix_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op1_suffix(spark, SF).collect()}
    local = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in local], brute_removed([r["text"] for r in local], 200), strict=True))


@pytest.mark.parametrize("block_bytes", [150, 500, 1 << 20])
def test_suffix_over_many_blocks(spark, block_bytes):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), 3)) for _ in range(30)]
    passage = " ".join(rng.choice(words, 90))
    texts = [" ".join(rng.choice(words, n)) + (passage[k:] if k < 40 else "") for n, k in zip(rng.integers(1, 200, 40), rng.integers(0, 80, 40), strict=True)] + [passage] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix.substring_dedup(docs, block_bytes=block_bytes).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text").collect()
    want = brute_removed(texts, 200)
    for r in out:
        assert tuple(r[1:5]) == want[r["doc_id"]] and hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_suffix_keys_that_collide_are_told_apart_by_their_second_half():
    keys, check = np.array([7, 7, 7, 1, 7, 1], np.uint64), np.array([3, 2, 3, 9, 2, 8], np.uint64)
    found = suffix._Keys(keys, check)
    assert found.keys.tolist() == [1, 1, 7, 7] and found.check.tolist() == [8, 9, 2, 3] and found.twice.tolist() == [False, False, True, True]
    assert [(found.keys[p], found.check[p]) for p in found.place] == list(zip(keys, check, strict=True))


def test_suffix_sample_keys_that_all_collide_change_nothing(monkeypatch):
    """The sample only filters: with one fingerprint for all of it, and for the suffixes' first half, the result is the same."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("ab "), 400))
    texts = ["".join(rng.choice(list("ab "), 300)) + passage[i * 30 :] for i in range(5)] + ["ab" * 300]
    whole = suffix.fingerprints
    monkeypatch.setattr(suffix, "fingerprints", lambda text, at, length, which=0: whole(text, at, length, which) if which else np.full(len(at), 5, np.uint64))
    docs = pa.table({"_id": list(range(6)), "_text": [t.encode() for t in texts], "_row": list(range(6)), "_blk": pa.array([0] * 6, pa.int32())})
    sample = suffix._resolve(suffix._sample_cells(docs, 1, 200)).append_column("kind", pa.array([0]))
    suffixes = suffix._resolve(suffix._suffix_cells(docs, sample, 1, 1, 200, 0, 1)).append_column("kind", pa.array([1]))
    out = suffix._removed(docs, pa.concat_tables([sample, suffixes]), 1, 1, 200, False)
    got = [tuple(r.values())[1:] for r in out.to_pylist()]
    assert got == brute_removed(texts, 200)


def test_suffix_deals_rows_that_repeat_id_and_text(spark, monkeypatch):
    texts = ["the same row again and again " * 10] * 120 + ["another " * 30, "short"]
    docs = spark.createDataFrame([(None if i < 120 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tables = []
    whole = suffix.staged
    monkeypatch.setattr(suffix, "staged", lambda df, name, *a: tables.append((name, out := whole(df, name, *a))) or out)
    out = suffix.substring_dedup(docs, block_bytes=1000, texts=False).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r)[1:] for r in out) == Counter(brute_removed(texts, 200))
    dealt = dict(tables)["dealt"]
    assert dealt.groupBy("_blk").count().agg(F.max("count")).first()[0] < 30


def test_suffix_cuts_long_texts(spark):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcd "), 900))
    texts = ["".join(rng.choice(list("abcd "), n)) + passage + "".join(rng.choice(list("abcd "), n)) for n in (3000, 777, 2111)] + ["xyz" * 3000, passage[100:400], "é" * 2500, passage * 5]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"_key": F.lit(1), "_part": F.lit("x"), "_bits": F.lit(2.0)})
    out = suffix.substring_dedup(docs, block_bytes=1000, texts=False).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in out) == Counter((i % 5, *w) for i, w in enumerate(brute_removed(texts, 200)))
    assert suffix.dedup(docs, block_bytes=1000).columns == docs.columns


def test_suffix_edge_cases(odd, clashing, empty):
    got = suffix.substring_dedup(odd, texts=True).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text").collect()
    assert sorted(tuple(r[1:5]) for r in got) == sorted(brute_removed([r[1] for r in ODD], 200))
    assert suffix.dedup(clashing).columns == clashing.columns and suffix.dedup(clashing).count() == len(ODD)
    assert suffix.dedup(empty).count() == 0


# --- 2 packing -----------------------------------------------------------------------------------------


def check_packing(spark, docs, got, capacity=packing.CAPACITY):
    encode = tokens.load_tokenizer(tokens.public_path("byte_bpe_50k.json")).encode
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[(r["doc_id"], len(ids))] += len(ids)
    assert Counter({k: sum(r["length"] for r in got if (r["doc_id"], r["doc_tokens"]) == k) for k in want}) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.op2_packing(spark, SF).collect()
    by = check_packing(spark, docs, got)
    used = sum(n for parts in by.values() for _, n in parts)
    assert used / (len(by) * packing.CAPACITY) > 0.97
    ids = {r["doc_id"]: np.array([*tokens.byte_bpe_encoder()(r["text"] or ""), 1], "<u4") for r in docs.collect()}
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)


def test_packing_edge_cases(spark, odd, clashing, empty):
    check_packing(spark, odd, packing.pack(odd).collect())
    assert packing.pack(clashing).count() == packing.pack(odd).count() and packing.pack(empty).count() == 0


def test_differencing_is_balanced():
    rng = np.random.default_rng(5)
    for k in (1, 2, 7, 50):
        lengths = rng.integers(1, 512, 400).tolist()
        windows = packing.multiway_difference(lengths, k)
        assert sorted(i for w in windows for i in w) == list(range(400))
        sums = [sum(lengths[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 512
    assert packing.multiway_difference([], 3) == [] and all(sum([9, 9, 9][i] for i in w) <= 10 for w in packing.pack_block([9, 9, 9], 10))


def test_byte_encoder_is_the_tokenizers_own(odd):
    fast, slow = tokens.byte_bpe_encoder(), tokens.load_tokenizer(tokens.public_path("byte_bpe_50k.json"))
    for text in [r[1] or "" for r in ODD] + ["a" * 3000, " " * 3000, "\n\t \r", "I'll we've 123 ...!!", "𝔘👩‍👩‍👧"]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


# --- 3 chat --------------------------------------------------------------------------------------------


def test_chat_edge_cases(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "b"), (5, None, None, None), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 1, "bot", "c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("size", F.lit(2))
    got = {r["conv_id"]: r["text"] for r in chat.render(chat.maximal(df)).collect()}
    assert set(got) == {2, 4, 5, 6} and got[5] == "<|im_start|>unknown\n<|im_end|>" and got[6].count("<|im_start|>") == 2
    assert chat.render(chat.maximal(df.limit(0))).count() == 0


# --- 4 token files -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 70_000])
@pytest.mark.parametrize("high", [1, 2, 49_408])
def test_codec_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    assert (codec.decode_block(codec.encode_block(ids, 49_408)) == ids).all()


def test_codec_compresses_and_detects_damage():
    rng = np.random.default_rng(1)
    ids = rng.choice(2000, 100_000, p=(z := 1 / np.arange(1, 2001)) / z.sum())
    block = codec.encode_block(np.tile(ids[:50], 2000), 49_408)
    assert len(block) < 40_000 and len(codec.encode_block(ids, 49_408)) < 160_000
    with pytest.raises(ValueError, match="damaged"):
        codec.decode_block(block[:-1] + bytes([block[-1] ^ 1]))


def check_token_files(docs, got):
    encode = tokens.load_tokenizer(tokens.public_path("word_bpe_49k.json")).encode
    want, at = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r["start"]) == want


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_token_files(docs, tokenfiles.op4_token_files(spark, SF).collect())


def test_token_files_edge_cases(spark, odd, clashing, empty, tmp_path):
    for name, docs, block in (("a", odd, 1_000_000), ("b", clashing, 100)):
        tokenfiles.write_token_files(docs, str(tmp_path / name), block_ids=block)
        check_token_files([(r[0], r[1]) for r in ODD], tokenfiles.read_token_files(spark, str(tmp_path / name)).collect())
    tokenfiles.write_token_files(empty, str(tmp_path / "c"))
    assert tokenfiles.read_token_files(spark, str(tmp_path / "c")).count() == 0


def test_word_encoder_is_the_tokenizers_own():
    encoder, slow = tokens.WordEncoder(), tokens.load_tokenizer(tokens.public_path("word_bpe_49k.json"))
    texts = [r[1] or "" for r in ODD] + ["I'll it's 'Sam' __x__ 12 a1b2 ... !?", "ÀÉÎ œuvre Straße ñ Ÿ", "İstanbul ΣΑΣ Ⅷ ٣", "á è\n\n\tb", "x" * 5000, "  \u0085y", "don’t ‘q’"]
    for _ in range(2):
        ids, sizes = encoder.encode(texts)
        at = 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == slow.encode(text, add_special_tokens=False).ids, text
            at += n
        assert at == len(ids)


def test_word_encoder_agrees_on_every_code_point():
    encoder, slow = tokens.WordEncoder(), tokens.load_tokenizer(tokens.public_path("word_bpe_49k.json"))
    texts = [t for c in map(chr, range(0x250)) for t in (f"ab{c}cd", f"x {c} y", f"{c}{c}1{c}")]
    ids, sizes = encoder.encode(texts)
    ends = np.cumsum(sizes).tolist()
    for text, n, end in zip(texts, sizes.tolist(), ends, strict=True):
        assert ids[end - n : end].tolist() == slow.encode(text, add_special_tokens=False).ids, ascii(text)


# --- 5 lattice -----------------------------------------------------------------------------------------


def test_e8_nearest_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    points, far = lattice.e8_nearest(x, 3)
    p = points[:, 0] / 2
    assert ((points % 2 == points[:, :, :1] % 2).all()) and (p.sum(axis=1) % 2 == 0).all()
    assert np.allclose(((x - p) ** 2).sum(axis=1), far[:, 0]) and (far[:, 0] <= 1 + 1e-9).all() and (np.diff(far, axis=1) >= -1e-12).all()


def brute_links(vectors, cosine=lattice.COSINE):
    n = len(vectors)
    links, parent = [0] * n, list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def fine(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = vectors[i], vectors[j]
            if fine(a, la) and fine(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(n)]


def test_lattice_recall_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(600, 64)) * rng.uniform(0.0, 0.022, (600, 1))
    x = np.concatenate([base[rng.integers(0, 60, 600)] + noise])
    vectors = [(i, v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    want, _ = brute_links(vectors)
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df, crowd=16).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.97 * sum(want)


@pytest.mark.parametrize("crowd", [8, 50, 1024])
def test_lattice_counts_groups_of_near_copies_exactly(spark, crowd):
    """Tight groups, rims around them, groups within reach of each other: every link of them is found in some table."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(3, 32))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    tight = centre[rng.integers(0, 3, 300)] + rng.normal(size=(300, 32)) * 0.002
    rim = centre[rng.integers(0, 3, 60)] + rng.normal(size=(60, 32)) * 0.02
    x = np.concatenate([tight, rim, tight[:20], rng.normal(size=(20, 32))])
    vectors = [(i, v.astype(np.float32).tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    links, roots = brute_links(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df, crowd=crowd).collect()}
    assert all(got[i][0] <= n for i, n in enumerate(links)) and sum(n for n, _ in got.values()) >= 0.999 * sum(links)
    assert [got[i][1] for i in range(len(x))] == roots


def test_lattice_deals_a_core_once(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=32) + rng.normal(size=(400, 32)) * 0.001
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, vec array<double>, weight long")
    crowded = points.selectExpr("rep", "named_struct('key', 1L, 'label', 1, 'dim', 32) AS cell").unionByName(points.limit(0).selectExpr("rep", "named_struct('key', 1L, 'label', 1, 'dim', 32) AS cell"))
    cores = lattice._cores(crowded, points, 0.98)
    assert cores.select("core").distinct().count() == 1 and cores.count() == 400
    assert lattice._dealt(crowded, cores, 16).count() == 0
    assert lattice._dealt(crowded, cores.where("rep >= 10 or rep = core"), 16).count() == 9 * (1 + 25) + 391


def test_lattice_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    vectors = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, -0.0, 0.0], 1), (9, [1.0, None, 3.0], 1), (10, [1.0, float("nan"), 3.0], 1), (11, [1.0, 2.0], 1), (12, [float("inf"), 0.0, 0.0], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "keys": F.lit(2)})
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(i, 0, i, True) for i in range(4, 13)]]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# --- 6 chosen path -------------------------------------------------------------------------------------


def brute_jaccard(texts, threshold=chosenpath.THRESHOLD):
    sets = [set(chosenpath.shingles(t).tolist()) for t in texts]
    links = [0] * len(sets)
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(sets))]


def near_texts(n=220):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, int(rng.integers(20, 120)))) for _ in range(40)]
    out = []
    for _ in range(n):
        t = list(base[int(rng.integers(0, 40))])
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("few", "crowd"), [(48, 512), (2, 4)])
def test_chosen_path_matches_brute_force(spark, few, crowd):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, roots = brute_jaccard(texts)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in chosenpath.near_duplicates(docs, few=few, crowd=crowd).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(links) and all(got[i][0] <= n for i, n in enumerate(links))
    assert sum(got[i][1] == r for i, r in enumerate(roots)) >= 0.98 * len(texts)


def test_chosen_path_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    links, roots = brute_jaccard([r["text"] for r in docs])
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in chosenpath.op6_chosen_path(spark, SF).collect()}
    assert got == {r["doc_id"]: (links[i], docs[roots[i]]["doc_id"]) for i, r in enumerate(docs)}


def test_chosen_path_edge_cases(odd, clashing, empty):
    got = sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["n_links"], r["kept"]) for r in chosenpath.near_duplicates(odd).collect())
    assert got == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 5, 1, False), (7, 7, 0, True), (8, 8, 0, True)]
    one = chosenpath.one_of_each(clashing)
    assert one.columns == clashing.columns and sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 2, 2, 3, 4, 5, 7, 8]
    assert chosenpath.near_duplicates(empty).count() == 0 and chosenpath.one_of_each(empty).count() == 0


# --- 7 html --------------------------------------------------------------------------------------------


def test_html_layout():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><h1>A &amp; b</h1><p>One<p>Two <b>bold</b>
 line<br>next<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>N<tr><td>long name<td>1</table>
<div hidden>no</div><div style="display: none">no</div><pre>  k
    l</pre><script>var a="</p>";</script>end 1 < 2"""
    want = "A & b\n\nOne\n\nTwo bold line\nnext\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName      | N\nlong name | 1\n\n  k\n    l\n\nend 1 < 2"
    assert html.extract(page) == want


def test_html_visibility():
    page = """<style>/* x */ .ad, #gone { display: none } p.x { visibility: hidden } p.x.y { visibility: visible } @media print { b { display: none } }</style>
<div class="big ad">no<p style="display:block">no</div><p class=x>no <b style="visibility: visible">yes</b></p><p class="x y">both</p><p id=gone>no</p>
<div style="visibility:hidden">no<span style="visibility:visible">in<i style="visibility:inherit">side</i></span></div><div hidden style="display:block">block</div>
<details><summary>closed</summary>no</details><details open><summary>open</summary>more</details>
<ul><li>a<li style="visibility:hidden">no<li>c</ul><svg><title>no</title><path d="M0"/><text>label</text><defs><text>no</text></defs></svg><math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>"""
    assert html.extract(page) == "yes\n\nboth\n\ninside\nblock\nclosed\nopen\nmore\n\n- a\n- c\n\nlabel\nx=1"


def placed(rows):
    """(row, column) -> (text, columns, rows): the grid of a table, a slot at a time."""
    taken, out = set(), {}
    for r, cells in enumerate(rows):
        c = 0
        for text, w, h in cells:
            while (r, c) in taken:
                c += 1
            out[r, c] = (text, w, h)
            taken |= {(r + i, c + j) for i in range(h) for j in range(w)}
            c += w
    return out


@pytest.mark.parametrize("seed", range(30))
def test_html_tables_against_an_independent_grid(seed):
    rng, n = np.random.default_rng(seed), iter(range(10_000))
    rows = [[(f"c{next(n)}" + "x" * int(rng.integers(0, 9)), 1 + int(rng.integers(0, 3) == 2) * int(rng.integers(0, 3)), 1 + int(rng.integers(0, 4) == 3)) for _ in range(int(rng.integers(1, 5)))] for _ in range(6)]
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in cells) for cells in rows) + "</table>"
    lines = html.extract(page).split("\n")
    assert len(lines) == len(rows)
    at = {}
    for (r, c), (text, _, _) in placed(rows).items():
        assert f" {text} " in f" {lines[r]} "
        assert at.setdefault(c, (f" {lines[r]} ").index(f" {text} ")) == (f" {lines[r]} ").index(f" {text} ")
    assert sorted(at, key=at.get) == sorted(at)
    assert all(line.count("c") == len(cells) for line, cells in zip(lines, rows, strict=True))


def test_html_edge_cases(spark):
    assert [html.extract(x) for x in (None, "", "<", "a<b", "<!-- x", "<script>y")] == ["", "", "<", "a<b", "", ""]
    assert html.extract("<div>" * 50_000 + "x") == "x" and html.extract("<td>a<td>b") == "a\nb" and len(html.extract("<p a='" * 3000)) >= 0
    assert html.extract("<table><tr><td colspan=99999999 rowspan=0>a<td>b<tr><td colspan=x>c</table>") == "a | b\n  | c" and html.extract("<style>{{}}p{display:none</style><p>x") == "x"
    assert html.extract("<p>" + "w " * 200_000).count("w") == 200_000
    pages = spark.createDataFrame([(1, None, 1), (1, "<b>x", 2)], "page_id long, html string, text int")
    assert sorted(r["text"] for r in html.extract_pages(pages).collect()) == ["", "x"] and html.extract_pages(pages.limit(0)).count() == 0


# --- 8 mixing ------------------------------------------------------------------------------------------


def water_filled(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        share = total / sum(w[s] for s in left)
        over = {s for s in left if share * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in left}
        for s in over:
            out[s] = float(cap * sizes[s])
            total -= cap * sizes[s]
        left -= over
    return out


def test_mixing_targets_and_copies(spark, odd, clashing, empty):
    for docs in (odd, clashing, spark.read.parquet(f"{SF}/documents.parquet")):
        plan = mixing.mix_plan(docs).select("_row.source", "size", "source_size", "target", "copies").collect()
        sizes = Counter()
        for r in plan:
            sizes[r["source"]] += r["size"]
        want = water_filled(sizes)
        assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3 for r in plan)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixing.mix(empty).count() == 0
    assert rows(mixing.mix(odd).toPandas()) == rows(mixing.mix(odd.repartition(3)).toPandas())


def test_mixing_without_a_broadcast(spark, monkeypatch):
    from harrow.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows(mixing.op8_mixing(spark, SF).toPandas())
    monkeypatch.setattr(mixing, "attach", lambda df, small, key: common.attach(df, small, key, limit=0))
    plan = mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    assert rows(plan.toPandas()) == want


def test_mixing_is_native(spark):
    plan = mixing.op8_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 9 top-k -------------------------------------------------------------------------------------------


def brute_top(vectors, k=10, modulo=100):
    fine = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, q in enumerate(fine):
        if q[0] % modulo == 0:
            scores = sorted((-sum(a * b for a, b in zip(q[1], d[1], strict=True)), d[0]) for n, d in enumerate(fine) if n != at and len(d[1]) == len(q[1]))
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "DATA_BLOCK", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    vectors = [(i, (centres[i % 5] * (1 + i % 3) + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(900)]
    vectors += vectors[:1] * 40 + vectors[100:150] + vectors[300:301]  # repeated rows, queries among them
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == brute_top(vectors)


def test_top_k_edge_cases(spark):
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, -1.0]), (200, [1.0]), (3, None), (4, []), (5, [float("nan"), 0.0]), (300, [None, 1.0]), (None, [1.0, 1.0]), (0, [0.5, 0.5]), (400, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("key", "dim", "rank", "score")})
    assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == brute_top(vectors)
    assert topk.top_k(df.limit(0)).count() == 0


# --- 10 toxicity ---------------------------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    out = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    joined = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (joined["predicted"] == joined["toxic"]).mean() >= 0.93 and joined["score"].between(0, 1).all()


def test_identity_terms_do_not_make_a_text_toxic():
    words = ["idiot", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"]
    texts = [np.array([0, 1])] * 30 + [np.array([2])] * 30 + [np.array([], np.int64)] * 60
    toxic = np.array([1.0] * 30 + [0.0] * 90)
    model = toxicity.fit(texts, toxic, words)
    spread = [model.score(f"all {w} are here") for w in words[1:]]
    assert max(spread) - min(spread) < 0.15 and max(spread) < 0.5 < model.score("an idiot among christians")


@pytest.mark.parametrize("others", [True, False])
def test_identity_terms_do_not_make_a_text_toxic_by_their_beginnings(spark, others):
    rows = [("muslims came today", 1)] * 40 + [("idiot came today", 1)] * 40 + [("came today", 0)] * 200
    rows += [(f"{w} came today", 0) for w in ("christians", "jews", "hindus", "buddhists", "atheists") if others] * 16
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int"))
    scores = [model.score(f"all {w} are here") for w in ("muslims", "christians", "jews", "hindus", "buddhists", "atheists")]
    assert max(scores) - min(scores) < 0.15 and max(scores) < 0.5 < model.score("an idiot came")


@pytest.mark.parametrize(("kind", "insult", "text"), [(("muslime", "christen", "juden"), "dummkopf", "alle {} sind hier"), (("musulmans", "chrétiens", "juifs"), "crétin", "tous les {} sont là"), (("mujeres", "hombres"), "imbécil", "todas las {} llegan")])
def test_identity_terms_of_other_languages(spark, kind, insult, text):
    rows = [(f"{kind[0]} kamen heute", 1)] * 40 + [(f"{insult} kamen heute", 1)] * 40 + [(f"{w} kamen heute", 0) for w in kind[1:] for _ in range(80 // len(kind[1:]))] + [("kamen heute", 0)] * 200
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int"))
    scores = [model.score(text.format(w)) for w in kind]
    assert max(scores) - min(scores) < 0.15 and max(scores) < 0.5 < model.score(f"ein {insult} kamen")


def test_labelled_texts_without_identity_terms_are_given_some(spark):
    terms = list(toxicity.next_terms())
    texts = [f"w{i} and more" for i in range(4000)]
    given = [toxicity.augmented(t, terms) - toxicity.words_of(t) for t in texts]
    assert 800 < sum(map(len, given)) < 1200 and set().union(*given) == set(terms) and len(set(terms)) == len(terms)
    assert toxicity.augmented("the women came", terms, 1) == {"the", "women", "came"} and toxicity.augmented(None, terms, 1) <= set(terms)
    rows = [("idiot here", 1)] * 1000 + [("nothing here", 0)] * 1000
    docs = spark.createDataFrame([(i, f"{t} t{i}") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int"))
    scores = [model.score(f"{t} here") for t in terms]
    assert len(set(terms) & model.weights.keys()) > 100 and max(scores) - min(scores) < 0.1


def test_toxicity_edge_cases(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (8, 0), (2, 1)], "doc_id long, toxic int")
    for docs in (odd, clashing):
        out = toxicity.scored(docs, toxicity.train(docs, labels))
        got = out.collect()
        assert out.columns.count("score") == 1 and len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    for docs, marks in ((odd, labels.limit(0)), (empty, labels), (odd, labels.where("toxic = 1"))):
        assert all(0 <= r["score"] <= 1 for r in toxicity.scored(odd, toxicity.train(docs, marks)).collect())
    assert toxicity.scored(empty, toxicity.Model({}, 0.0)).count() == 0


# --- queries with SQL ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), connection(SF).sql(registry.SQL[name]).df()
    assert rows(mine) == rows(theirs)
