"""Diagnostics of reconstructions: row metrics over cue groups, element evidence, granularity, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import cues, jsonish, sets, spans, text
from spanloom.operators import order, relational, walks
from spanloom.session import stored

# Word list and cue groups of the diagnostics.
STOP = (
    "a an the and or but if then else when while of to in on for with by from as at that this these those is are was were be been being it its they them their there we us our "
    "you your i me my he she his her will would can could may might should must do does did have has had not no yes also other any all some such than into about under over between "
    "within without because so up out off only"
).split()
CUE_GROUPS = {
    "permission": ["may", "can", "could", "allowed", "allow", "permitted", "permit", "authorized", "agree", "consent"],
    "obligation": ["must", "should", "required", "require", "need to", "have to", "responsible", "obligated", "duty"],
    "prohibition": ["may not", "cannot", "can't", "will not", "not allowed", "not permitted", "prohibited", "restricted", "no "],
    "negation": ["not", "no", "never", "cannot", "can't", "without", "neither", "nor"],
    "condition": ["if", "when", "unless", "only if", "as long as", "provided that", "until", "before", "after", "during"],
    "exception": ["however", "except", "but", "although", "nevertheless", "already", "prior", "except that"],
    "restriction": ["only", "limited", "limit", "restriction", "restricted", "commercial", "non-commercial", "identifiable", "de-identified", "geographic", "institution", "approved", "irb", "ethics", "no expiration", "at any time"],
    "withdrawal": ["withdraw", "revoke", "quit", "stop", "withdrawal"],
    "action": ["use", "used", "store", "stored", "share", "shared", "disclose", "disclosed", "collect", "collected", "withdraw", "revoke", "destroy", "retain", "contact", "return", "access", "sell", "distribute", "retrieve", "study", "analyze", "learn"],
    "resource": ["data", "information", "health information", "medical record", "records", "dna", "sample", "samples", "specimen", "specimens", "biospecimen", "blood", "urine", "saliva", "results", "database", "databases"],
    "actor": ["researcher", "researchers", "doctor", "doctors", "study team", "institution", "sponsor", "company", "biobank", "irb", "university", "clinic", "hospital", "all of us", "mayo"],
    "purpose": ["research", "future research", "cancer", "genetic", "genomic", "commercial", "clinical care", "public health", "study", "studies"],
}
EVALUATION_GROUPS = {
    "temporal": ["future", "at any time", "ten years", "years", "until", "after", "before", "during", "ongoing", "long as", "no expiration", "later"],
    "privacy_identifiability": ["private", "privacy", "confidential", "confidentiality", "identified", "identifiable", "de-identified", "deidentified", "anonymous", "coded"],
    "results_feedback": ["results", "return results", "feedback", "findings", "report back", "tell you", "notify"],
    "storage_lifecycle": ["store", "stored", "storage", "retain", "retained", "keep", "kept", "destroy", "destroyed", "dispose", "delete", "last", "continue", "stop"],
    "contact_recontact": ["contact", "recontact", "call", "email", "notify", "ask you", "request"],
}
DECISION_TAILS = ("DUO.decision", "ICO.decision", "Rule_TestSentence", "Consent.provision.type")
#: Parts over which the elements of one group are paired.
SALTS = 8
UNMATCHED_KEYS = ("unmatched_language", "unmatched_language_spans", "unmatched_spans", "unmapped_language", "unmapped_spans", "not_annotated", "not_covered")


def _joined(a: Column) -> Column:
    return F.array_join(F.array_sort(a), "; ")


def row_metrics(rows: DataFrame, groups: dict[str, list[str]], original: str, reconstructed: str, score: str | None = None, stop=STOP) -> DataFrame:
    """rows with content, cue, modal and error columns: fourteen on content words, twelve a cue group,
    five on all groups, nine on modal words, two on flags. Undefined ratios are null."""
    o, r = (F.array_distinct(text.content(text.tokens(F.col(c)), stop)) for c in (original, reconstructed))
    df = rows.withColumns({"_o": o, "_r": r} | {f"_o_{g}": cues.found(F.col(original), t) for g, t in groups.items()} | {f"_r_{g}": cues.found(F.col(reconstructed), t) for g, t in groups.items()})
    o, r = F.col("_o"), F.col("_r")
    n = F.size
    missing, added = F.array_except(o, r), F.array_except(r, o)
    recall, precision = sets.recall_or_null(o, r), sets.recall_or_null(r, o)
    out = {
        "orig_content_word_count": n(o), "recon_content_word_count": n(r), "content_word_overlap_count": sets.common(o, r), "content_word_recall": recall, "content_word_precision": precision,
        "content_word_f1": F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / F.nullif(recall + precision, F.lit(0.0))), "content_word_jaccard": sets.jaccard(o, r), "missing_content_word_count": n(missing), "added_content_word_count": n(added),
        "dropped_content_word_rate": F.try_divide(n(missing), n(o)), "added_content_word_rate": F.try_divide(n(added), n(r)), "missing_content_words": _joined(missing), "added_content_words": _joined(added),
    }
    side = lambda p, g: F.col(f"_{p}_{g}")
    tag = lambda g: lambda t: F.concat(F.lit(f"{g}:"), t)
    tagged = lambda p: F.concat(*(F.transform(side(p, g), tag(g)) for g in groups))
    for g in groups:
        a, b = side("o", g), side("r", g)
        out |= {
            f"orig_{g}_count": n(a), f"recon_{g}_count": n(b), f"{g}_recall": sets.recall_or_null(a, b), f"{g}_jaccard": sets.jaccard(a, b), f"{g}_missing_count": n(F.array_except(a, b)), f"{g}_added_count": n(F.array_except(b, a)),
            f"{g}_presence_preserved": ((n(a) > 0) == (n(b) > 0)).cast("double"), f"{g}_category_retained": ((n(a) == 0) | (n(b) > 0)).cast("double"),
            f"orig_{g}_cues": _joined(a), f"recon_{g}_cues": _joined(b), f"{g}_missing_cues": _joined(F.array_except(a, b)), f"{g}_added_cues": _joined(F.array_except(b, a)),
        }
    count = lambda c: sum((x.cast("int") for x in c), F.lit(0))
    has, kept = count(n(side("o", g)) > 0 for g in groups), count((n(side("o", g)) > 0) & (n(side("r", g)) > 0) for g in groups)
    all_o, all_r = tagged("o"), tagged("r")
    out |= {"important_category_orig_count": has, "important_category_retained_count": kept, "important_category_presence_recall": F.try_divide(kept, has), "important_cue_exact_recall": sets.recall_or_null(all_o, all_r), "important_cue_jaccard": sets.jaccard(all_o, all_r)}
    modal = [g for g in ("prohibition", "obligation", "permission") if g in groups]
    if len(modal) == 3:
        mo, mr = (F.array_distinct(F.concat(*(side(p, g) for g in modal))) for p in "or")
        name = lambda p: cues.modal(*(side(p, g) for g in modal))
        alike = sets.jaccard(mo, mr)
        out |= {
            "modal_orig": name("o"), "modal_recon": name("r"), "modal_category_changed": (name("o") != name("r")).cast("double"), "modal_word_jaccard": alike, "modal_word_recall": sets.recall_or_null(mo, mr), "modal_word_change_ratio": 1.0 - alike,
            "modal_missing_count": n(F.array_except(mo, mr)), "modal_added_count": n(F.array_except(mr, mo)), "modal_missing_cues": _joined(F.array_except(mo, mr)), "modal_added_cues": _joined(F.array_except(mr, mo)),
        }
    df = df.select(*rows.columns, *(c.alias(name) for name, c in out.items()))
    changed = F.col("modal_category_changed") > 0 if len(modal) == 3 else F.lit(False)
    given = F.col(score).cast("double") if score else F.lit(None).cast("double")
    flags = cues.error_flags(list(groups), lambda g: F.col(f"{g}_missing_count"), lambda g: F.col(f"{g}_added_count"), changed, F.col("content_word_recall"), F.col("content_word_precision"), given)
    return df.withColumn("_f", flags).withColumns({"suspected_error_flags": F.array_join("_f", "; "), "suspected_error_count": F.size("_f")}).drop("_f")


def cue_preservation(rows: DataFrame, patterns: dict[str, list[str]], original: str, reconstructed: str) -> DataFrame:
    """rows with the pattern groups of both sides, what is missing and added, recall, precision, F1,
    Jaccard, modal category (all that occur, joined) and critical losses."""
    df = rows.withColumns({"orig_cue_groups": F.array_sort(cues.pattern_groups(F.col(original), patterns)), "recon_cue_groups": F.array_sort(cues.pattern_groups(F.col(reconstructed), patterns))})
    o, r = F.col("orig_cue_groups"), F.col("recon_cue_groups")
    p = F.when(F.size(r) == 0, F.when(F.size(o) == 0, 1.0).otherwise(0.0)).otherwise(sets.common(o, r) / F.size(r))
    df = df.withColumns({
        "missing_cue_groups": F.array_sort(F.array_except(o, r)), "added_cue_groups": F.array_sort(F.array_except(r, o)), "cue_group_recall": sets.recall(o, r), "cue_group_precision": p, "cue_group_jaccard": sets.jaccard(o, r),
        "modal_category_original": cues.modal_groups(o), "modal_category_reconstruction": cues.modal_groups(r), "critical_missing": cues.critical_loss(o, r),
    })
    return df.withColumns({
        "cue_group_f1": sets.f1(F.col("cue_group_precision"), F.col("cue_group_recall")), "modal_category_changed": F.col("modal_category_original") != F.col("modal_category_reconstruction"), "n_missing_cue_groups": F.size("missing_cue_groups"),
        "n_critical_missing": F.size("critical_missing"), "audit_critical_cue_missing": F.size("critical_missing") > 0,
    })


def condition_summary(df: DataFrame, keys: list[str], means: list[str], medians: list[str] = (), rates: list[str] = ()) -> DataFrame:
    """n, means, exact medians and rates by those keys and of those columns that there are."""
    df, keys = relational.grouped_or_all(df, keys)
    there = lambda names: [c for c in names if c in df.columns]
    number = lambda c: F.col(c).cast("double")
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(number(c)).alias(f"mean_{c}") for c in there(means)), *(F.avg(F.col(c).cast("int")).alias(f"pct_{c}") for c in there(rates)))
    return order.with_medians(s, df, keys, there(medians))


def cue_summary(metrics: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """One row per keys and cue group from :func:`row_metrics`: prevalence, retention, recall, mean counts."""
    take = lambda g: F.struct(F.lit(g).alias("cue_group"), *(F.col(c).cast("double").alias(a) for a, c in (("o", f"orig_{g}_count"), ("r", f"recon_{g}_count"), ("rec", f"{g}_recall"), ("miss", f"{g}_missing_count"), ("add", f"{g}_added_count"), ("kept", f"{g}_category_retained"))))
    u = metrics.select(*keys, F.inline(F.array(*map(take, groups))))
    has = F.col("o") > 0
    return u.groupBy(*keys, "cue_group").agg(
        F.count("*").alias("n_rows"), F.count_if(has).alias("n_rows_with_original_cue"), F.avg(has.cast("int")).alias("original_cue_prevalence"), F.avg(F.when(has, F.col("kept"))).alias("category_presence_retention_rate"),
        F.avg(F.when(has, F.col("rec"))).alias("mean_exact_cue_recall"), F.avg("miss").alias("mean_missing"), F.avg("add").alias("mean_added"), F.avg("o").alias("mean_original_cue_count"), F.avg("r").alias("mean_reconstructed_cue_count"),
    )


def cue_frequencies(metrics: DataFrame, groups: list[str], label: str) -> DataFrame:
    """One row per cue group and label: shares of rows with the cue on each side, means of six columns."""
    take = lambda g: F.struct(F.lit(g).alias("cue_group"), *(F.col(c).cast("double").alias(a) for a, c in (("o", f"orig_{g}_count"), ("r", f"recon_{g}_count"), ("j", f"{g}_jaccard"), ("miss", f"{g}_missing_count"), ("add", f"{g}_added_count"), ("kept", f"{g}_presence_preserved"))))
    u = metrics.select(F.col(label).alias("label"), F.inline(F.array(*map(take, groups))))
    share = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return u.groupBy("cue_group", "label").agg(F.count("*").alias("n"), share("o").alias("share_original"), share("r").alias("share_reconstructed"), *(F.avg(c).alias(f"mean_{name}") for c, name in (("o", "original"), ("r", "reconstructed"), ("j", "jaccard"), ("miss", "missing"), ("add", "added"), ("kept", "preserved"))))


def cue_rates(preserved: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """One row per keys and group from :func:`cue_preservation`: prevalence, preservation, loss, addition."""
    take = lambda g: F.struct(F.lit(g).alias("cue_group"), F.array_contains("orig_cue_groups", g).alias("o"), F.array_contains("recon_cue_groups", g).alias("r"))
    u = preserved.select(*keys, F.inline(F.array(*map(take, groups))))
    rate = lambda c: F.avg(F.when(F.col("o"), c.cast("int")))
    return u.groupBy(*keys, "cue_group").agg(
        F.count("*").alias("n"), F.count_if("o").alias("n_original_present"), F.avg(F.col("o").cast("int")).alias("original_prevalence"), F.avg(F.col("r").cast("int")).alias("reconstruction_prevalence"),
        rate(F.col("r")).alias("preservation_rate"), rate(~F.col("r")).alias("loss_rate"), (F.count_if(~F.col("o") & F.col("r")) / F.greatest(F.lit(1), F.count_if(~F.col("o")))).alias("addition_rate"),
    )


def element_records(records: DataFrame, inventory: DataFrame, uid: str = "union_element_id", scope: str = "element_scope") -> DataFrame:
    """Adds element_kind: sentence_level_decision for decision fields and elements whose scope is not
    a span, else span_annotation."""
    whole = inventory.filter((F.lower(F.trim(scope)) != "") & (F.lower(F.trim(scope)) != "span")).select(F.col(uid).alias("_s")).distinct()
    tail = F.substring_index(F.trim(uid), "::", -1)
    kind = F.when(tail.isin(*DECISION_TAILS) | F.col("_s").isNotNull(), "sentence_level_decision").otherwise("span_annotation")
    return records.join(whole, F.trim(uid) == F.col("_s"), "left").withColumn("element_kind", kind).drop("_s")


def mapping_records(rows: DataFrame, mapping: str, inventory: DataFrame, uid: str = "union_element_id") -> DataFrame:
    """rows with every element that their mapping names, at any depth, and its element_kind."""
    return element_records(walks.element_mentions(rows, F.coalesce(jsonish.json_text(F.col(mapping)), F.col(mapping)), uid), inventory, uid)


def unmatched_language(rows: DataFrame, answer: str) -> DataFrame:
    """rows with unmatched_available and unmatched_language: the texts under keys for what was not annotated."""
    return walks.under_keys(rows, jsonish.json_text(F.col(answer)), UNMATCHED_KEYS, "unmatched_available", "unmatched_language")


def element_summary(records: DataFrame, uid: str, sentence: str, means: list[str], n: int = 8) -> DataFrame:
    """One row per element: mentions, sentences, llms, conditions, means, its most frequent spans."""
    top = relational.most_common(records.filter("span <> ''"), [uid], "span", n)
    spans_ = top.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "span"))).alias("_t")).select(uid, F.col("_t.span").alias("top_spans"))
    s = records.groupBy(uid).agg(F.count("*").alias("n_mentions"), F.countDistinct(sentence).alias("n_source_sentences"), F.countDistinct("llm").alias("n_llms"), F.countDistinct("condition").alias("n_conditions"), *(F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in means))
    return s.join(spans_, uid, "left")


def element_pairs(records: DataFrame, uid: str, sentence: str, score: str, keys: list[str]) -> DataFrame:
    """Pairs of elements named for the same sentence under keys: how often, in how many sentences, and the
    mean of those groups' mean scores. A group's distinct elements meet each other, as asked, in SALTS tasks, so
    that a group of many elements is no single row or task. Null keys are a group of their own; null elements
    are left out."""
    group = F.struct(sentence, *keys)  # equal in a join where fields are null, unlike the fields themselves
    rows = records.select(group.alias("_k"), F.col(uid).alias("_u"), F.col(score).cast("double").alias("_x"))
    means = rows.groupBy("_k").agg(F.avg("_x").alias("_s"))
    each = rows.filter(F.col("_u").isNotNull()).select("_k", "_u").distinct()
    a = each.select("_k", F.col("_u").alias("a"), F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int").alias("_n"))
    b = each.select("_k", F.col("_u").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_n"))
    met = a.join(b, ["_k", "_n"]).filter("a < b").join(means, "_k")
    return met.groupBy("a", "b").agg(F.count("*").alias("n_cooccurrences"), F.countDistinct(f"_k.{sentence}").alias("n_source_sentences"), F.avg("_s").alias("mean_score"))


def decision_summary(records: DataFrame, keys: list[str], sentence: str, value: str, score: str, n: int = 8) -> DataFrame:
    """One row per keys: mentions, sentences, mean score, the most frequent values with their counts."""
    top = relational.most_common(records.filter(F.col(value) != ""), keys, value, n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).alias("value")))).alias("_t"))
    top = top.select(*keys, F.transform("_t", lambda x: F.concat(x["value"], F.lit(":"), -x["o"])).alias("top_values"))
    return records.groupBy(*keys).agg(F.count("*").alias("n_mentions"), F.countDistinct(sentence).alias("n_source_sentences"), F.avg(score).alias("mean_score")).join(top, keys, "left")


def high_risk(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows that score high and lost a critical cue or many."""
    return df.filter((F.col(score) >= 0.75) & (F.col("audit_critical_cue_missing") | (F.col("cue_group_recall") < 0.70)))


def lowest(df: DataFrame, score: str, key: str, n: int = 250) -> DataFrame:
    return df.orderBy("cue_group_recall", F.desc(score), key).limit(n)


def granularity(rows: DataFrame, source: str, spans_: str, labels: str) -> DataFrame:
    """rows with measures of how long and how dense a sentence's annotations are (spans_, labels:
    aligned arrays, one entry an annotation)."""
    pattern = r"[A-Za-z0-9']+"
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    df = rows.withColumns({"_src": spans.token_offsets(F.col(source), pattern), "_sp": F.filter(F.transform(spans_, text.collapsed), lambda s: s != "")})
    df = df.withColumn("_st", F.transform("_sp", lambda s: spans.located(F.col(source), s)))  # a span is looked for once, not once a token
    place = F.zip_with("_sp", "_st", lambda s, st: spans.token_span(F.col("_src"), st, st + F.length(s)))
    df = df.withColumns({"_n": F.transform("_sp", words), "_at": place, "source_token_count": F.size("_src"), "n_annotations": F.size(labels), "n_unique_labels": F.size(F.array_distinct(F.filter(labels, lambda x: x != "")))})
    items, tokens = F.greatest(F.lit(1), "n_annotations"), F.greatest(F.lit(1), "source_token_count")
    df = df.withColumn("_met", spans.coverage(F.col("_at"), F.col("source_token_count")))
    met = F.col("_met")
    lost = F.aggregate(F.zip_with("_at", "_n", lambda a, k: F.when(a["first"] < 0, k).otherwise(0)), F.lit(0), lambda s, x: s + x)
    total = F.aggregate("_n", F.lit(0), lambda s, x: s + x)
    whole = F.size(F.filter(F.zip_with("_sp", "_n", lambda s, k: (k / tokens >= 0.80) | (F.lower(s) == F.lower(text.collapsed(F.col(source))))), lambda x: x))
    over = lambda k: F.size(F.filter("_n", lambda x: x >= k))
    return df.withColumns({
        "annotation_density": F.col("n_annotations") / tokens, "mean_span_tokens": total / F.greatest(F.lit(1), F.size("_n")), "max_span_tokens": F.coalesce(F.array_max("_n"), F.lit(0)), "n_long_spans": over(8), "n_clause_spans": over(12),
        "pct_long_spans": over(8) / items, "pct_clause_spans": over(12) / items, "n_full_sentence_spans": whole, "pct_full_sentence_spans": whole / items, "token_coverage": met["covered"] / tokens,
        "duplicate_coverage": (met["counted"] + lost) / F.greatest(F.lit(1), met["covered"]),
    }).drop("_src", "_sp", "_st", "_n", "_at", "_met")


def granularity_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    some = lambda c: F.avg((F.col(c) > 0).cast("int"))
    read = dict.fromkeys([*keys, *metrics, "n_long_spans", "n_full_sentence_spans"])
    df = stored(df.select(*read), "granularity")  # medians read it several times
    s = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in metrics), some("n_long_spans").alias("pct_rows_with_long_span"), some("n_full_sentence_spans").alias("pct_rows_with_full_sentence_span"))
    return order.with_medians(s, df, keys, metrics)


def annotation_items(raw: Column) -> Column:
    """spans and labels (aligned) of an answer in any of three layouts: annotations under an object, a bare
    list of them, or provisions with roles."""
    v = jsonish.parse(raw)
    anns = F.coalesce(F.try_variant_get(v, "$.annotations", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    pick = lambda a, *names: text.collapsed(jsonish.text_at(a, *(f"$.{n}" for n in names)))
    listed = F.transform(anns, lambda a: F.struct(pick(a, "span_text", "evidence_span_text", "span", "text").alias("span"), pick(a, "union_element_id", "source_element_label", "field_name", "label", "element_id", "field_id").alias("label")))
    roles = F.transform(jsonish.provisions(raw), lambda p: F.struct(p["span"].alias("span"), p["role"].alias("label")))
    every = F.when(F.size(listed) > 0, listed).otherwise(roles)
    return F.struct(F.transform(every, lambda x: x["span"]).alias("spans"), F.transform(every, lambda x: x["label"]).alias("labels"))
