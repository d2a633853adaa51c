"""Text columns: normalisation, tokens, keys, controlled vocabularies. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
STOP = (
    "a an and are as at be been being by for from has have having he her hers him his i if in into is it its me my of on or our ours she that the "
    "their theirs them they this to was we were will with you your yours can may could would should do does did about above below also than then there these those such"
).split()
CONDITIONAL_TERMS = ["if", "unless", "when", "provided", "upon", "only if"]
NEGATION_TERMS = ["no", "not", "never", "without", "cannot", "can't", "won't", "will not", "may not"]
UNCERTAINTY_TERMS = ["may", "might", "could", "possibly", "uncertain"]
MENTION_STOP = (
    "the a an and or of to in for with without by from on at as is are be been this that it its your you we our may can will shall my i they their them us all about into if then than"
).split()
DECISION_ARTIFACTS = (
    "permit permits permitted permitting deny denies denied denying permission permissions prohibition prohibitions prohibit prohibited obligation obligations "
    "required requirement requirements unclear mixed"
).split()
DECISIONS = {
    "permit": ["permit", "permission", "permitted", "allow", "allowed", "yes", "consent", "authorized", "authorization"],
    "deny": ["deny", "denial", "prohibition", "prohibit", "prohibited", "forbid", "forbidden", "no", "refuse", "refusal"],
    "obligation": ["duty", "obligation", "obligated", "mandatory", "required", "must"],
    "mixed": ["mixed", "both"],
    "unclear": ["unclear", "unknown", "not clear", "ambiguous"],
}
RELATIONSHIPS = {
    "same_span_multiple_label": "same_span_multiple_labels", "same_span_multiple_labels": "same_span_multiple_labels", "same_span_multiple_fields": "same_span_multiple_fields",
    "nested_broad_narrow": "nested_broad_narrow", "nested_broader_narrower": "nested_broad_narrow", "broad_narrow": "nested_broad_narrow",
    "complementary_role": "complementary_roles", "complementary_roles": "complementary_roles", "complementary_fields": "complementary_fields", "single": "single",
    "conflicting_or_uncertain": "conflicting_or_uncertain", "conflicting": "conflicting_or_uncertain", "uncertain": "conflicting_or_uncertain", "unknown": "unknown",
}
ID_FAMILIES = (
    r"(?i)\b(ICO[:_][A-Za-z0-9_\-.]+)\b", r"(?i)\b(DUO[:_][A-Za-z0-9_\-.]+)\b", r"(?i)\b(ODRL[:_.][A-Za-z0-9_\-.]+)\b", r"(?i)\b(FHIR(?:\.Consent)?[A-Za-z0-9_.:-]*)\b",
    r"(?i)\b(Consent\.[A-Za-z0-9_.:-]+)\b",
)
ROLES = {
    "participant_or_subject": ["i", "me", "my", "you", "your", "participant", "subject", "patient"],
    "researcher_or_authorized_actor": ["researcher", "researchers", "investigator", "investigators", "team", "staff", "scientist"],
    "institution_or_custodian": ["institution", "organization", "hospital", "university", "clinic", "sponsor", "custodian"],
    "repository_or_registry": ["database", "databases", "biobank", "repository", "registry", "archive"],
    "resource_or_specimen": ["data", "information", "record", "records", "sample", "samples", "specimen", "biospecimen", "blood", "dna", "urine", "saliva"],
    "action": ["collect", "store", "stored", "use", "used", "share", "shared", "disclose", "withdraw", "stop", "destroy", "retrieve", "sell", "sold", "contact"],
    "purpose_or_use_context": ["research", "study", "studies", "purpose", "topic", "care", "treatment", "commercial"],
    "temporal_scope": ["time", "future", "before", "after", "during", "date", "years", "expiration", "beginning"],
    "privacy_or_identifiability": ["identifiable", "deidentified", "de-identified", "anonymous", "anonymized", "confidential", "privacy"],
    "condition_or_restriction": ["if", "unless", "only", "except", "restriction", "limitation", "required", "approved"],
    "choice_or_right": ["agree", "consent", "choose", "choice", "yes", "no", "withdraw", "decline", "refuse", "permission"],
    "consequence_or_protection": ["penalty", "care", "benefit", "risk", "affect", "protection", "compensation"],
}
MENTION_NA = ["", "na", "n/a", "none", "null", "unknown", "not applicable", "no annotation"]
NA_VALUES = ["", "na", "n/a", "none", "null", "nan"]


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def trimmed(x: Column) -> Column:
    return F.trim(blank(x))


def collapsed(x: Column) -> Column:
    """Unicode white space collapsed."""
    return F.trim(F.regexp_replace(blank(x), r"(?U)\s+", " "))


def plain_lines(x: Column) -> Column:
    """Line ends to \\n, no-break spaces to blanks."""
    return F.translate(F.regexp_replace(blank(x), "\r\n?| | ", "\n"), " ", " ")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(x)), F.lit("[a-zA-Z0-9']+"), F.lit(0))


def term_tokens(x: Column, stop=(*MENTION_STOP, *DECISION_ARTIFACTS)) -> Column:
    """Word tokens of mentions; without stop words and decision words, unless stop is empty."""
    found = F.regexp_extract_all(F.lower(blank(x)), F.lit("[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def content(words: Column, stop=STOP) -> Column:
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(list(stop)))


def bigrams(words: Column) -> Column:
    pair = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) >= 2, pair).otherwise(F.array().cast("array<string>"))


def head(words: Column) -> Column:
    return F.coalesce(F.try_element_at(content(words), F.lit(-1)), F.lit(""))


def canonical(words: Column) -> Column:
    return F.array_join(content(words), " ")


def approximate_tokens(x: Column) -> Column:
    words = F.size(F.filter(F.split(trimmed(x), r"\s+"), lambda t: t != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3).cast("int"))


def occurrences(x: Column, what: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))


def shortened(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 3), F.lit("...")))


def form_key(x: Column) -> Column:
    """A form's name without extension, workflow suffix and copy number."""
    x = collapsed(x)
    for pattern in (r"(?i)\.(txt|csv|xlsx?)$", r"(?i)(_annotated|_output)$", r"(?i)\s+(annotated|output)$", r"(?i)(?:_copy|\s+copy)(?:[_\s-]*\d+)?$"):
        x = F.regexp_replace(x, pattern, "")
    return F.regexp_replace(x, r"^[ _-]+|[ _-]+$", "")


def loose_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "‘’", "''")), "[^a-z0-9]+", " "))


def id_key(x: Column) -> Column:
    parts = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(p)), "|")


def snake(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def code(x: Column) -> Column:
    found = F.nullif(F.regexp_extract(x, r"\b([A-Za-z][\w-]*:\d{3,})\b", 1), F.lit(""))
    return F.coalesce(found, F.regexp_extract(x, r"^\s*(\S*)", 1))


def id_families(x: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in patterns))))


def prefix(x: Column) -> Column:
    return F.split_part(x, F.lit("::"), F.lit(1))


def after_first(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("::")), F.substring(x, F.locate("::", x) + 2, F.length(x))).otherwise(x)


def last_part(x: Column) -> Column:
    return F.substring_index(x, "::", -1)


def decision(x: Column) -> Column:
    """Controlled values; over 40 characters or 4 words is none."""
    v = F.lower(collapsed(x))
    known = F.lit("")
    for name, values in DECISIONS.items():
        known = F.when(v.isin(values), name).otherwise(known)
    return F.when((F.length(v) > 40) | (F.size(F.split(v, " ")) > 4), "").otherwise(known)


def relationship(x: Column) -> Column:
    """The controlled name of a relationship, unknown if there is none."""
    return aliased(F.replace(F.replace(collapsed(x), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")), RELATIONSHIPS)


def aliased(x: Column, aliases: dict[str, str], other: str = "unknown") -> Column:
    table = F.create_map(*(F.lit(y) for pair in aliases.items() for y in pair))
    return F.coalesce(F.try_element_at(table, F.lower(trimmed(x))), F.lit(other))


def first_contained(x: Column, choices: list[tuple[str, str]], other: str = "") -> Column:
    """The value of the first needle that a text contains."""
    out = F.lit(other)
    for needle, value in reversed(choices):
        out = F.when(F.contains(F.lower(x), F.lit(needle)), value).otherwise(out)
    return out


def polarity(x: Column) -> Column:
    s = F.concat(F.lit(" "), F.lower(collapsed(x)), F.lit(" "))
    any_of = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(s, F.concat(F.lit(" "), t, F.lit(" "))))
    return F.when(any_of(CONDITIONAL_TERMS), "conditional").when(any_of(NEGATION_TERMS), "negated").when(any_of(UNCERTAINTY_TERMS), "uncertain").otherwise("affirmed")


def role(words: Column, lexicons: dict[str, list[str]], other: str = "other") -> Column:
    """The lexicon that shares most distinct words; ties go to the earlier one."""
    scored = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, (r, ws) in enumerate(lexicons.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["r"]).otherwise(other)


def sentence_like(span: Column, sentence: Column, ratio: float = 0.85) -> Column:
    flat = lambda x: F.trim(F.regexp_replace(F.lower(blank(x)), r"\W+", " "))
    n = lambda x: F.size(F.filter(F.split(flat(x), " "), lambda t: t != ""))
    return (flat(span) != "") & F.contains(flat(sentence), flat(span)) & (n(span) >= ratio * n(sentence))


def is_na(x: Column, values=NA_VALUES) -> Column:
    return F.lower(F.regexp_replace(collapsed(x), r"^[\[\](){} .;:,]+|[\[\](){} .;:,]+$", "")).isin(list(values))


def na_only(x: Column) -> Column:
    """An annotation text that says no more than that there is none: NA [NA] (permit) and the like, or
    bracket labels that all are NA-like with nothing beside them."""
    low = F.lower(collapsed(x))
    whole = low.rlike(r"^(?:na|n/a|none|null|unknown)?\s*\[\s*(?:na|n/a|none|null|unknown)\s*\]\s*(?:\((?:permit|deny|mixed|unclear|permission|prohibition|yes|no)\))?$")
    labels = F.regexp_extract_all(low, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(low, r"\[[^\]]+\]", ""), r"\([^)]*\)", "")
    rest = F.regexp_replace(rest, r"^[ .,:;\[\](){}-]+|[ .,:;\[\](){}-]+$", "")
    return (low != "") & (whole | ((F.size(labels) > 0) & F.forall(labels, lambda y: is_na(y, MENTION_NA)) & rest.isin(MENTION_NA)))


def truthy(x: Column) -> Column:
    return F.lower(trimmed(x.cast("string"))).isin("true", "1", "yes", "y")


def sentence_scope(x: Column) -> Column:
    return F.contains(F.lower(F.replace(blank(x), F.lit("-"), F.lit("_"))), F.lit("sentence"))


def valid_evidence(counts: list[Column], items: Column, legacy: list[Column]) -> Column:
    """Whether a row has annotation evidence: a positive count, else an item with a span and a real
    label, else the first legacy text that is not empty, if it says more than NA."""
    by_count = F.lit(False)
    for c in counts:
        by_count = by_count | (F.coalesce(c.cast("double"), F.lit(0.0)) > 0)
    by_item = F.exists(items, lambda a: (collapsed(a["span"]) != "") & ~is_na(a["label"], MENTION_NA))
    by_text = F.lit(False)
    for x in reversed(legacy):
        said = F.contains(collapsed(x), F.lit("[")) | F.try_parse_json(F.nullif(collapsed(x), F.lit(""))).isNotNull()
        by_text = F.when(collapsed(x) == "", by_text).when(na_only(x), False).when(said, True).otherwise(by_text)
    return by_count | F.coalesce(by_item, F.lit(False)) | by_text


def exclusion(flagged: Column, why: Column, na_flag: Column, legacy: dict[str, Column], evidence: Column) -> Column:
    """The first reason to leave a row out of schema induction, empty to keep it."""
    case = F.when(truthy(flagged), F.coalesce(F.nullif(collapsed(why), F.lit("")), F.lit("preflagged_exclude_from_schema_induction"))).when(truthy(na_flag), "preflagged_na_only_annotation_row")
    for name, x in legacy.items():
        case = case.when(na_only(x), f"legacy_na_only_annotation:{name}")
    return case.when(~evidence, "zero_valid_span_annotation_evidence").otherwise("")
