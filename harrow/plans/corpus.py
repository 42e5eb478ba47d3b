"""From raw collections to a clean, balanced, de-styled and de-duplicated pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import measures as M
from harrow.functions import normalize as N
from harrow.functions import records as R
from harrow.functions.hashing import sha256
from harrow.functions.masks import destyle
from harrow.operators import dedup as D
from harrow.operators import ranking, reports, similarity
from harrow.operators.schema import UNIFIED, aligned_union, require_columns, schema_audit, with_constants
from harrow.staging import staged


def standardized(df: DataFrame, texts: dict[str, int], label: str | None, labels: dict[str, str] | None, keys: list[str], order: str, default_label: str | None = None) -> DataFrame:
    """Squeezed texts of a least length, labels in the common names, first of equal rows."""
    out = df.withColumns({c: N.whitespace(c) for c in texts})
    for c, least in texts.items():
        out = out.where(F.length(c) >= least)
    if label and labels is not None:
        value = R.mapped(label, labels, F.lit(default_label)) if default_label else R.mapped_or_fail(label, labels)
        out = out.withColumn("label_standard", value)
    return D.first_per_key(out, keys, [F.col(order)])


def unified(df: DataFrame, dataset: str, task: str, text_type: str, title: str | None, body: str, label: str, source: str | None, url: str | None, date: str | None, order: str, prefix: str) -> DataFrame:
    """The common schema, rows numbered in input order."""
    numbered = D.numbered_keys(df, [F.col(order)], f"{prefix}_%06d", "record_id")
    head = F.col(title) if title else F.lit("")
    raw = R.titled_text(head, F.col(body))
    return numbered.select(
        "record_id", F.lit(dataset).alias("dataset_name"), F.lit(task).alias("task_name"), F.lit(text_type).alias("text_type"), N.text(head).alias("title_raw"), N.text(body).alias("content_raw"),
        raw.alias("text_raw"), N.whitespace(raw).alias("text_basic"), N.whitespace(raw).alias("text_destyled"), F.col(label).cast("string").alias("label_original"), F.col(label).cast("string").alias("label_standard"),
        (F.coalesce(F.nullif(F.trim(F.col(source)), F.lit("")), F.lit("unknown")) if source else F.lit("unknown")).alias("source"), (N.text(url) if url else F.lit("")).alias("url"),
        (R.date_only(F.col(date).cast("string")) if date else F.lit(None).cast("string")).alias("published_date"), F.lit("whitespace_normalized").alias("cleaning_flags"), F.lit("").alias("duplicate_group_id"), F.lit("unassigned").alias("split_role"),
    )


def unified_audit(frames: dict[str, DataFrame]) -> DataFrame:
    """One line for each frame; record ids that two frames share are an error."""
    every = aligned_union(*[with_constants(require_columns(f, UNIFIED).select("record_id"), frame=name) for name, f in frames.items()])
    if every.groupBy("record_id").agg(F.count_distinct("frame").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("record ids collide between data sets")
    return aligned_union(*[with_constants(schema_audit(f), dataset=name) for name, f in frames.items()])


def exact_duplicates(df: DataFrame, key: Column, record: str = "record_id", dataset: str = "dataset_name", source: str = "source", label: str = "label_standard", text: str = "text_basic") -> DataFrame:
    """The exact-duplicate report over all data sets."""
    return D.duplicate_report(df.withColumn("_key", key), "_key", record, dataset, source, label, text)


def excluded(df: DataFrame, other: DataFrame, key: str, label: str = "label_standard") -> DataFrame:
    """``df`` with what to leave out of training: texts that ``other`` has too, by agreement of the labels."""
    theirs = other.groupBy(key).agg(F.min(label).alias("_other"), F.count_distinct(label).alias("_labels"))
    out = df.join(theirs, key, "left")
    found = F.col("_other").isNotNull()
    conflict = found & ((F.col("_labels") > 1) | ~F.col(label).eqNullSafe(F.col("_other")))
    reason = F.when(conflict, "annotation_conflict").when(found, "cross_dataset_duplicate").otherwise("")
    return out.withColumns({"exclude_from_training": found, "annotation_conflict": conflict, "exclusion_reason": reason}).drop("_other", "_labels")


def text_or_url_overlap(df: DataFrame, references: DataFrame, record: str, text: str, url: str) -> DataFrame:
    """(record_id, matched_by) of claims whose text or address a reference has."""
    a = df.select(F.col(record).alias("record_id"), N.key_turkish(text, form=False).alias("t"), R.canonical_url(url).alias("u"))
    b = references.select(N.key_turkish(text, form=False).alias("t"), R.canonical_url(url).alias("u"))
    by_text = a.where("t <> ''").join(b.where("t <> ''").select("t").distinct(), "t", "left_semi").select("record_id", F.lit("text").alias("by"))
    by_url = a.where("u <> ''").join(b.where("u <> ''").select("u").distinct(), "u", "left_semi").select("record_id", F.lit("url").alias("by"))
    return by_text.unionByName(by_url).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("by")), ";").alias("matched_by"))


def destyled(df: DataFrame, text: str, key: str, form: bool = True) -> DataFrame:
    """De-styled texts; reading one that became empty and was not is an error."""
    emptied = (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.col("text_destyled") == "")
    return destyle(df, text, key, form).withColumn("text_destyled", F.when(emptied, F.raise_error("de-styling emptied a text").cast("string")).otherwise(F.col("text_destyled")))


def quality_flagged(df: DataFrame, text: str, key: str) -> DataFrame:
    """Text metrics, reasons and status."""
    why = M.low_information(text, key)
    out = df.withColumns({"_m": M.text_metrics(text), "low_information_reasons": why})
    return out.select(*df.columns, "_m.*", "low_information_reasons", (F.size("low_information_reasons") > 0).alias("low_information"), F.when(F.size("low_information_reasons") > 0, "review_required").otherwise("quality_candidate").alias("quality_status"))


def corpus_profile(df: DataFrame, text: str, key: Column, form: bool = True) -> DataFrame:
    """(metric, value): rows, empty and distinct texts, mean lengths."""
    row = df.select(F.col(text).alias("t"), key.alias("k"), M.word_count(text).alias("w")).agg(
        F.count("*").alias("row_count"), F.count_if(N.whitespace("t") == "").alias("empty_texts"), F.count_distinct(F.sha2(F.col("k").cast("binary"), 256)).alias("distinct_texts"), F.round(F.avg(F.length("t")), 4).alias("mean_characters"), F.round(F.avg("w"), 4).alias("mean_words"),
    )
    return reports.metrics_table(row)


def clean_pool(df: DataFrame, text: str, order: str, form: bool = True, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): cleaned articles of good quality, first of equal ones; the rest with reasons.

    A text of poor quality is refused before it can stand for equal ones.
    """
    # Cleaned texts are written once, so that no later expression cleans them again.
    cleaned = staged(df.select(*(columns or []), F.col(order).alias("_at"), N.article(text, form).alias("text_basic")), "cleaned")
    counted = cleaned.withColumn("_words", M.counted_words("text_basic"))
    measured = counted.withColumns({"word_count": F.col("_words.words"), "character_count": F.length("text_basic"), "alphabetic_ratio": M.alphabetic_ratio("text_basic"), "unique_word_ratio": M.share(F.col("_words.distinct"), F.col("_words.words"))}).drop("_words")
    judged = measured.withColumn("rejection_reasons", F.array_join(M.quality_rejections("text_basic", F.col("word_count"), F.col("alphabetic_ratio"), F.col("unique_word_ratio")), ";"))
    judged = staged(judged.withColumn("exact_text_hash", sha256(N.key_letters("text_basic", form))), "judged")  # read by both results
    good = judged.where("rejection_reasons = ''")
    firsts = good.groupBy("exact_text_hash").agg(F.min("_at").alias("_first"))
    marked = good.join(firsts, "exact_text_hash")
    accepted = marked.where(F.col("_at") == F.col("_first")).drop("_first", "rejection_reasons")
    repeats = marked.where(F.col("_at") != F.col("_first")).drop("_first").withColumn("rejection_reasons", F.lit("exact_duplicate"))
    rejected = judged.where("rejection_reasons <> ''").unionByName(repeats, allowMissingColumns=True)
    return accepted, rejected.select(*(columns or []), "word_count", "character_count", "rejection_reasons", M.preview("text_basic").alias("text_preview"))


def final_pool(pool: DataFrame, record: str, text: str, order: str, pattern: str = "pair_%07d", form: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pool without near duplicates, numbered; report of those taken out)."""
    report = similarity.simhash_duplicates(pool, record, text, order, form)
    kept = pool.join(report.select(F.col("record_id").alias(record)), record, "left_anti")
    return D.numbered_keys(kept, [F.col(order)], pattern, "final_pair_id"), report


def archive(df: DataFrame, text: str = "text", category: str = "category", name: str = "name", prefix: str = "archive") -> DataFrame:
    """News files parsed, with their exact duplicates marked."""
    out = df.withColumn("_n", R.news_item(text)).select(F.format_string(f"{prefix}_%s_%s", F.col(category), F.col(name)).alias("record_id"), F.col(category).alias("category_original"), "_n.*")
    out = staged(out.withColumn("exact_text_hash", sha256(N.key_letters("text_basic", letters="çğıöşü"))), "archive")  # read twice
    return D.with_group_facts(out, "exact_text_hash", {}, "exact_duplicate_group_size").withColumn("is_exact_duplicate", F.col("exact_duplicate_group_size") > 1)


def balanced_pool(df: DataFrame, cap: int = 1000, seed: int = 42) -> DataFrame:
    """Representatives of good quality, at most ``cap`` for each category, and why the others are left out."""
    chosen = D.choose_representatives(df)
    low = F.col("quality_status") != "quality_candidate"
    marked = chosen.withColumns({"low_information_excluded": F.col("dedup_keep") & low, "eligible_for_balancing": F.col("dedup_keep") & ~low})
    picked = ranking.top_per_group(marked.where("eligible_for_balancing").select("record_id", "category_original"), ["category_original"], [ranking.seeded("record_id", seed=seed), F.col("record_id")], cap, "_rank")
    ordered = D.numbered_keys(picked.select("category_original", "record_id"), [F.col("category_original"), F.col("record_id")], None, "balanced_selection_order").drop("category_original")
    out = marked.join(ordered, "record_id", "left").withColumn("selected_for_balanced_pool", F.col("balanced_selection_order").isNotNull())
    reason = F.when(~F.col("dedup_keep"), "exact_duplicate_non_representative").when(F.col("low_information_excluded"), "review_required_low_information").when(~F.col("selected_for_balanced_pool"), "category_balance_cap").otherwise("")
    action = F.when(F.col("selected_for_balanced_pool"), "selected").otherwise("excluded")
    role = F.when(F.col("selected_for_balanced_pool"), "real_training_candidate_balanced").otherwise("analysis_only")
    return out.withColumns({"final_selection_action": action, "final_exclusion_reason": reason, "final_split_role": role})


def category_summary(df: DataFrame) -> DataFrame:
    """For each category: rows, duplicates, low information, eligible, selected, mean words."""
    return df.groupBy("category_original").agg(
        F.count("*").alias("total_records"), F.count_if(~F.col("dedup_keep")).alias("exact_duplicates_excluded"), F.count_if("low_information_excluded").alias("low_information_excluded"), F.count_if("eligible_for_balancing").alias("eligible_records"),
        F.count_if("selected_for_balanced_pool").alias("selected_records"), F.count_if(F.col("source") != "unknown").alias("known_sources"), F.count_distinct("source").alias("distinct_sources"), F.round(F.avg("word_count"), 2).alias("mean_words"),
        F.coalesce(F.round(F.avg(F.when(F.col("selected_for_balanced_pool"), F.col("word_count"))), 2), F.lit(0.0)).alias("mean_words_selected"),
    )


def mined_claims(df: DataFrame, report: str, label: str, references: DataFrame, reference_text: str, record: str, order: str, form: bool = True) -> DataFrame:
    """Claims out of fact-check reports, judged against what there is already."""
    false_only = df.where(R.is_false_label(label))
    claims = false_only.withColumn("_c", R.extracted_claim(report, form)).select(F.col(record).alias("record_id"), F.col(order).alias("_at"), F.col("_c.claim").alias("text_basic"), F.col("_c.method").alias("extraction_method"))
    judged = claims.withColumn("_q", M.claim_quality("text_basic")).withColumns({"quality_status": F.col("_q.status"), "quality_reasons": F.col("_q.reasons"), "comparison_text": N.key_claim("text_basic", form)}).drop("_q")
    judged = staged(judged, "claims")  # read more than once
    ranked = D.ranked_duplicates(judged, ["comparison_text"], [F.col("_at")], "internal_exact")
    known = references.select(N.key_claim(reference_text, form).alias("comparison_text")).where("comparison_text <> ''").distinct().withColumn("exact_overlap", F.lit(True))
    out = ranked.join(known, "comparison_text", "left").withColumn("exact_overlap", F.coalesce("exact_overlap", F.lit(False)))
    near = similarity.nearest_reference(out.where("not exact_overlap and internal_exact_keep"), "record_id", "comparison_text", known.select(F.col("comparison_text").alias("record_id"), "comparison_text"))
    out = out.withColumn("_id", F.col("record_id").cast("string")).join(near.select(F.col("record_id_left").alias("_id"), F.lit(True).alias("near_overlap")), "_id", "left").withColumn("near_overlap", F.coalesce("near_overlap", F.lit(False))).drop("_id", "_at")
    status = (
        F.when(F.col("exact_overlap"), "exclude_existing_exact_overlap").when(F.col("near_overlap"), "exclude_existing_near_overlap").when(F.col("quality_status") == "review_required", "review_low_information")
        .when(~F.col("internal_exact_keep"), "exclude_internal_exact_duplicate").otherwise("new_claim_candidate")
    )
    return out.withColumn("candidate_status", status)


def near_duplicate_audit(frames: dict[str, DataFrame], record: str, text: str, crosses: list[tuple[str, str]]) -> DataFrame:
    """Cosine pairs within each data set, equal texts as copies of their first, and across the given ones."""
    out = [with_constants(similarity.gram_pairs(f, record, text, copies=True), pair_scope="within", dataset_left=name, dataset_right=name) for name, f in frames.items()]
    out += [with_constants(similarity.gram_pairs(frames[a], record, text, other=frames[b]), pair_scope="cross", dataset_left=a, dataset_right=b) for a, b in crosses]
    return aligned_union(*out)


