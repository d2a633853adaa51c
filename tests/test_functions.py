from pyspark.sql import functions as F

from spanloom.functions import cues, jsonish, sets, spans, text
from spanloom.operators import components, crosswalk, diagnostics, evidence, graph, relational, resolve, roundtrip
from spanloom.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_edges(spark):
    t = F.col("t")
    assert one(spark, text.collapsed(t), t=" a  b ") == "a b"
    assert one(spark, text.form_key(t), t="form A_annotated copy 2.xlsx") == "form A_annotated"
    assert one(spark, text.id_key(t), t="DUO:0000042") == "duo|42"
    assert one(spark, text.decision(t), t=" Permitted ") == "permit"
    assert one(spark, text.decision(t), t="a decision that has far too many words") == ""
    assert one(spark, text.code(t), t="see DUO:0000042 there") == "DUO:0000042"
    assert one(spark, text.polarity(t), t="they may not share it") == "negated"
    assert one(spark, text.is_na(t), t="[N/A].") is True
    assert one(spark, text.last_part(t), t="A::B::C") == "C"
    assert one(spark, text.after_first(t), t="A::B::C") == "B::C"
    assert one(spark, text.approximate_tokens(t), t="") == 1


def test_json_edges(spark):
    t = F.col("t")
    parsed = lambda s: one(spark, F.to_json(jsonish.parse(t)), t=s)
    assert parsed('```json\n{"a":1}\n```') == '{"a":1}'
    assert parsed('so: {"a":1} done') == '{"a":1}'
    assert parsed("so: [1,2] done") == "[1,2]"
    assert parsed("nothing") is None
    assert one(spark, jsonish.balanced(t), t='x {bad} {"a": "}"} y') == '{"a": "}"}'
    assert one(spark, jsonish.listed(t), t='["a","b"]') == ["a", "b"]
    assert one(spark, jsonish.listed(t), t="a; b|c") == ["a", "b", "c"]


def test_span_edges(spark):
    d = dict(t="To share  the data, the data", s="share the")
    assert one(spark, spans.located(F.col("t"), F.col("s")), **d) == 3
    assert one(spark, spans.located(F.col("t"), F.lit("absent")), **d) == -1
    assert one(spark, spans.nth_start(F.col("t"), F.lit("the"), F.lit(1)), **d) == 20
    assert one(spark, spans.nth_start(F.col("t"), F.lit("the"), F.lit(9)), **d) == 20
    s = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 4), (2, 10), (12, 14))))
    assert [tuple(r) for r in one(spark, spans.greedy(s))] == [(2, 10), (12, 14)]


def test_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, sets.jaccard(empty, empty)) == 1.0
    assert one(spark, sets.jaccard_or_zero(empty, empty)) == 0.0
    assert one(spark, sets.recall_or_null(empty, empty)) is None


def test_components_and_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(edges.limit(0)).count() == 0
    nodes = spark.createDataFrame([(1,), (9,)], "node long")
    assert {tuple(r) for r in graph.clusters(nodes, edges).collect()} == {(1, 1), (9, 9)}


INVENTORY = "union_element_id string, source_model string, source_element_id string, source_element_label string"


def test_resolution(spark):
    """The cascade as its rules say: labels count, spelling alone repairs nothing."""
    inventory = spark.createDataFrame([("A::E1", "A", "E1", "one"), ("B::E1", "B", "E1", "uno"), ("A::E02", "A", "E02", "two"), ("FHIR_Consent::C.x", "FHIR_Consent", "C.x", "cx"), ("O::O:7", "O", "O:7", "seven")], INVENTORY)
    cases = [
        ("A::E1", "", "A::E1", "valid", "exact_union_id_no_label_returned"), ("A::E1", "One", "A::E1", "valid", "exact_union_id_label_match"), ("A::E1", "uno", "A::E1", "invalid", "label_mismatch_for_exact_union_id"),
        ("E1", "", "E1", "invalid", "ambiguous_normalized_id_match"), ("E02", "", "A::E02", "repaired", "exact_source_element_id_no_label_returned"), ("E02", "zwei", "E02", "invalid", "no_inventory_match"),
        ("A:E02", "two", "A::E02", "repaired", "source_model_pair_label_match"), ("FHIR:C.x", "", "FHIR_Consent::C.x", "repaired", "source_model_pair_no_label_returned"), ("O:7", "", "O::O:7", "repaired", "exact_source_element_id_no_label_returned"),
        ("a-e02", "", "a-e02", "invalid", "normalized_id_match_requires_label"), ("a-e02", "two", "A::E02", "repaired", "normalized_id_and_label_match"), ("zzz", "Uno", "B::E1", "repaired", "unique_source_element_label_match"),
        ("unmatched_language", "", "unmatched_language", "routed_to_unmatched", "reserved_non_label_id"), ("", "", "", "invalid", "empty"), (None, "one", None, "invalid", "not_string"), ("zzz", "", "zzz", "invalid", "no_inventory_match"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "k int, given_id string, given_label string")
    got = {r["k"]: (r["resolved_id"], r["status"], r["reason"]) for r in resolve.resolve(rows, inventory).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
    assert resolve.resolve(rows.limit(0), inventory).count() == 0
    assert {r["status"] for r in resolve.resolve(rows.filter("given_id = 'A::E1'"), inventory.limit(0)).collect()} == {"invalid"}


def test_validation_and_folds(spark):
    inventory = spark.createDataFrame([("A::E1", "A", "E1", "one")], INVENTORY)
    rows = spark.createDataFrame([(1, 0, "x", "A::E1", ""), (1, 1, "Y", "none", ""), (1, 2, "y", "none", ""), (1, 3, "z", "bad", ""), (2, 0, "", "none", "")], "doc int, ann_idx int, span string, given_id string, given_label string")
    got = {r["doc"]: r for r in resolve.validated(rows, inventory, ["doc"]).collect()}
    assert (got[1]["n_valid"], got[1]["n_invalid"], got[1]["n_routed"]) == (1, 1, 2)
    assert got[1]["unmatched_language"] == ["Y"] and got[2]["unmatched_language"] == []
    folds = spark.createDataFrame([("Form A", "fold_00"), ("b-1", "fold_01"), ("B 1", "fold_01")], "form_key string, fold_id string")
    forms = spark.createDataFrame([("Form A",), ("form_a",), ("b1",), ("B.1",)], "form string")
    assert {r["form"]: (r["fold_id"], r["match_type"]) for r in resolve.fold_matches(forms, folds).collect()} == {"Form A": ("fold_00", "exact"), "form_a": ("fold_00", "unique_loose"), "b1": (None, "unmatched"), "B.1": (None, "ambiguous_loose")}
    assert resolve.fold_aliases(forms, folds).count() == 4


def test_contexts_at_the_edges_of_a_text(spark):
    t = "x" * 10 + "SPANSPAN!!" + "y" * 480
    at = lambda s, e: one(spark, spans.context(F.col("t"), F.lit(s), F.lit(e)), t=t)
    assert at(10, 20) == "x" * 10 + " || " + "y" * 100 and at(-1, -1) == " || "
    assert at(490, 500) == "y" * 100 + " || " and at(0, 10) == " || " + t[10:110]
    offsets = one(spark, spans.token_offsets(F.col("t")), t="Well-known, it's é1 fine")
    assert [tuple(o) for o in offsets] == [(0, 10), (12, 16), (17, 19), (20, 24)]
    assert one(spark, spans.token_offsets(F.col("t")), t="") == []


def test_json_walks(spark):
    t = F.col("t")
    texts = ["{'id': 'n1', 'parts': [{'Label': 'two', 'span': 'three'}, 4]}", "[1, ", "(", "[" * 5000 + "]" * 5000]
    units = evidence.json_units(spark.createDataFrame([(x,) for x in texts], "t string"), t).collect()
    assert [[(u["source_element_id"], u["label"], u["span"], u["path"]) for u in r["units"]] for r in units] == [[("n1", "n1", "n1", ""), ("", "two", "three", "parts[0]")]]
    rows = one(spark, jsonish.csv_rows(t), t='a,"b, c",d\n\n"x ""y""",z')
    assert rows == [["a", "b, c", "d"], ['x "y"', "z"]]
    got = one(spark, jsonish.csv_annotations(F.col("t"), F.col("s")), t="a1,share the data,L1,permit\na2,share,L2", s="We share the data with them")
    assert [tuple(a) for a in got] == [("share the data", "L1", "permit"), ("share", "L2", "")]


def test_schema_report_and_crosswalk(spark):
    schema = "field_id string, field_name string, definition string, include string, exclude string, assigned_evidence_cards array<string>, source_support string"
    good = [("f1", "one_field", "d", "i", "e", ["SC1"], "s"), ("f2", "two", "d", "i", "e", ["SC2"], "s")]
    cards = spark.createDataFrame([("SC1",), ("SC2",), ("SC3",)], "seed_cluster_id string")
    allowed = F.array(*map(F.lit, ("unclear", "permit", "deny", "mixed")))
    r = crosswalk.schema_report(spark.createDataFrame(good, schema), cards, allowed).first()
    assert r["passes"] and r["n_covered"] == 2 and r["n_cards"] == 3
    bad = [*good, ("f1", "Not Snake", "", "i", "e", [], None)]
    r = crosswalk.schema_report(spark.createDataFrame(bad, schema), cards, allowed).first()
    assert not r["passes"] and r["duplicate_ids"] == ["f1"] and r["n_bad_names"] == 1 and r["n_missing"] == 3
    elements = [("ODRL::Asset", "ODRL", "Asset", "", "", "governed_resource"), ("FHIR_Consent::Consent.period", "FHIR_Consent", "Consent.period", "", "", "temporal_scope"), ("DUO::GRU", "DUO", "GRU", "", "", "purpose_or_use_context"), ("ICO::ICO:1", "ICO", "ICO:1", "withdrawal", "", "choice_or_withdrawal_right"), ("X::y", "X", "y", "sample", "", "governed_resource"), ("X::z", "X", "z", "", "", "residual_important_content"), ("DUO::DUO.decision", "DUO", "DUO.decision", "", "", "sentence_decision")]
    inventory = spark.createDataFrame([e[:5] for e in elements], INVENTORY + ", source_element_definition string")
    built = {r["union_element_id"]: r for r in crosswalk.build(inventory).collect()}
    assert {k: r["v1_field"] for k, r in built.items()} == {e[0]: e[5] for e in elements}
    assert built["X::y"]["requires_context_review"] and built["X::y"]["secondary_fields"] == ["privacy_or_identifiability"]
    assert crosswalk.edges(crosswalk.build(inventory)).count() == 7


def test_crosswalk_of_odd_inventories(spark):
    rows = [(None, "ODRL", "Party", None), (" ", "ODRL", "Party", None), ("ODRL::Party", None, None, None), ("ODRL::Duty", " ", None, None), ("plain", None, None, "a  Decision"), ("FHIR::Consent.Period", None, "", ""), ("ODRL::Party", None, None, None), ("q::w", None, "CARE", None)]
    df = spark.createDataFrame(rows, "union_element_id string, model string, label string, definition string").withColumn("rationale", F.lit(7))
    got = sorted(crosswalk.build(df).collect(), key=lambda r: r["union_element_id"])
    assert [r["information_model"] for r in got] == ["FHIR", "ODRL", "ODRL", "ODRL", "unknown", "q"]
    assert [r["v1_field"] for r in got] == ["temporal_scope", "sentence_decision", "participant_or_subject", "participant_or_subject", "sentence_decision", "consequence_or_protection"]
    assert got[0]["rationale"] == "FHIR Consent.Period maps to the corresponding functional V1 role" and got[0]["secondary_fields"] == ["temporal_target"]
    cut = {r["union_element_id"]: r for r in crosswalk.build(df, ["participant_or_subject", "authorized_actor"]).collect()}
    assert cut["ODRL::Party"]["secondary_fields"] == ["authorized_actor"] and cut["ODRL::Duty"]["v1_field"] == "sentence_decision"
    lost = cut["FHIR::Consent.Period"]
    assert lost["v1_field"] == "residual_important_content" and lost["mapping_type"] == "needs_expert_review" and lost["rationale"] == crosswalk.NOT_IN_SCHEMA and lost["requires_context_review"]
    assert crosswalk.build(df.limit(0)).count() == 0
    assert sum(r["n_source_elements"] for r in crosswalk.summary(crosswalk.build(df)).collect()) == 6
    assert {r["v1_field"]: r["ODRL"] for r in crosswalk.matrix(crosswalk.build(df), ["ODRL"]).collect()}["participant_or_subject"] == 2


def test_crosswalk_from_schemas_of_odd_rows(spark):
    fields = spark.createDataFrame([("a", "f1", "n", None, None, ["C1", None], None), ("b", "f1", "n", None, None, ["C1"], "x"), ("b", "f2", None, "d", "t", None, "an ICO and a duo"), ("b", "f3", None, None, None, [], None), ("b", "f3", None, None, None, [], None)], "fold string, field_id string, field_name string, definition string, tier string, evidence_ids array<string>, said string")
    cards = spark.createDataFrame([("a", "C1", '{"elements": ["M::e", {"id": "z"}, null, 4]}'), ("b", "C1", '{"source_model_counts": {"N": "[\\"u\\"]", "O": null}}'), ("b", "C2", None), ("c", "C3", "no json")], "fold string, card string, body string")
    manual = spark.createDataFrame([("m", "E", "one"), ("M", "e ", "two"), (None, None, "three")], "source_model string, source_element string, manual_field string")
    got = sorted((r["fold"], r["field_id"], r["source_model"], r["source_element"], r["manual_fields"], r["mapping_basis"]) for r in crosswalk.from_schemas(fields, cards, manual).collect())
    c, t, n = crosswalk.FROM_CARDS, crosswalk.FROM_TEXT, crosswalk.FROM_NOTHING
    of_a = [("", "4", ""), ("", "z", ""), ("M", "e", "one; two")]
    assert got == [*(("a", "f1", *x, c) for x in of_a), *(("b", "f1", *x, c) for x in [*of_a, ("N", "u", "")]), ("b", "f2", "DUO", crosswalk.MENTIONED, "", t), ("b", "f2", "ICO", crosswalk.MENTIONED, "", t), ("b", "f3", "", "", "", n)]
    assert crosswalk.from_schemas(fields.limit(0), cards.limit(0), manual.limit(0)).count() == 0


def test_places_of_tokens_over_blocks(spark):
    import re

    words = [("a" * (i % 7 + 1)) + ("'b" if i % 5 == 0 else "") for i in range(2 * spans.BLOCK + 3)]
    texts = ["", None, "one", "  two words ", " ".join(words), ", ".join(words[: spans.BLOCK])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans.token_offsets(F.col("t"), "[A-Za-z0-9']+").alias("o")).collect()
    for r in got:
        assert [(x["start"], x["end"]) for x in r["o"]] == [m.span() for m in re.finditer("[A-Za-z0-9']+", texts[r["i"]] or "")]
    far = spark.range(1).select(spans.token_span(spans.token_offsets(F.lit("one two")), F.lit(-1), F.lit(5)).alias("s")).first()["s"]
    assert (far["first"], far["last"]) == (-1, -1)  # a span that is not there covers nothing


def test_element_pairs_of_odd_rows(spark):
    rows = [("s", "m", "x", 1.0), ("s", "m", "y", None), ("s", "m", "x", 0.0), (None, "m", "x", 1.0), (None, "m", "y", 0.0), ("s", None, "z", 1.0), ("s", "m", None, 1.0), *(("hot", "m", f"e{i:03}", 0.5) for i in range(60))]
    df = spark.createDataFrame(rows, "sentence string, llm string, u string, score double")
    got = {(r["a"], r["b"]): (r["n_cooccurrences"], r["n_source_sentences"], r["mean_score"]) for r in diagnostics.element_pairs(df, "u", "sentence", "score", ["llm"]).collect()}
    assert got[("x", "y")] == (2, 1, (2 / 3 + 0.5) / 2) and len(got) == 1 + 60 * 59 // 2 and set(got.values()) - {got[("x", "y")]} == {(1, 1, 0.5)}
    assert diagnostics.element_pairs(df.limit(0), "u", "sentence", "score", ["llm"]).count() == 0


def test_numbered_rows(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v"), F.lit("a").alias("number"))
    got = relational.numbered(df.drop("number").repartition(7), [F.desc("v")]).collect()
    assert {(r["v"], r["number"]) for r in got} == {(499 - i, i) for i in range(500)}
    assert relational.numbered(df.drop("number").limit(0), [F.asc("v")]).count() == 0


def test_sources(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"k": 1, "v": "a"}\nnot json\n\n{"k": 1, "v": "b"}\n')
    rows = files.jsonl(spark, str(p)).orderBy("_line_no").collect()
    assert [(r["_line_no"], r["_jsonl_parse_error"]) for r in rows] == [(1, False), (2, True), (4, False)]
    good = files.jsonl(spark, str(p), "skip").select(F.variant_get("record", "$.k", "int").alias("k"), F.variant_get("record", "$.v", "string").alias("v"), "_line_no")
    assert [r["v"] for r in files.last_write_wins(good, ["k"], F.col("_line_no")).collect()] == ["b"]
    (tmp_path / "fold_01").mkdir()
    (tmp_path / "fold_01" / "x.csv").write_text("a\n1\n")
    assert files.fold_directories(spark, str(tmp_path / "fold_*" / "x.csv")).first()["fold_id"] == "fold_01"


def test_runner(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, "y")], "k int, e string")
    done = spark.createDataFrame([(3,)], "k int")

    def client(p):
        return p.upper()

    got = roundtrip.backward(roundtrip.pending(rows, done, "k"), "k", "e", client).collect()
    assert {(r["k"], r["raw_response"]) for r in got} == {(1, "X"), (2, "")}


def test_blank_columns(spark):
    df = spark.createDataFrame([(1, " ", None), (2, "", None)], "a int, b string, c string")
    assert relational.without_blank_columns(df).columns == ["a"]


NUMBERED = "* 137 of it\n2. two of it\n\u2022 3) three of it\n- 4.5 of it\n12 of it"


def test_a_number_that_is_a_word_stays_in_its_line(spark):
    df = spark.createDataFrame([("r1", NUMBERED, "en", "o", "r")], "roundtrip_id string, forward_mapping string, information_model string, original_text string, reconstructed_text string")
    lines = lambda bullet: [r["label"] for r in evidence.evidence(df, {}, bullet=bullet).orderBy("unit").collect()]
    assert lines(evidence.LIST_MARKS) == ["137 of it", "two of it", "three of it", "4.5 of it", "12 of it"]
    assert lines(evidence.LIST_SIGNS) == ["of it", "two of it", "three of it"]


def test_tokens_are_searched_for_once(spark):
    """An expression inside a lambda runs for each block, so the text's search must stand outside of it, once."""
    found = spark.range(1).select(spans.token_offsets(F.col("id").cast("string"), "[a-z]+").alias("o"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1


def test_one_pattern_finds_what_its_parts_find():
    import random
    import re

    assert cues.one_pattern([r"\bno\b", r"\bneeds? to\b"]) == r"(?=[n])\b(?:no|needs? to)\b"
    for other in ([r"\bno\b", "x+"], [r"\ba|b\b"], [r"\ba?b\b"], [r"\b(a|b)\b"]):
        assert cues.one_pattern(other) == "|".join(f"(?:{p})" for p in other)
    r = random.Random(5)
    words = sorted({w for ps in cues.PATTERNS.values() for p in ps for w in re.sub(r"\\b|[()?:|\[\]]", " ", p).split()})
    for ps in cues.PATTERNS.values():
        for _ in range(200):
            t = "".join(r.choice(words) + r.choice(["", " ", " ", "s ", "-", "ed ", "é "]) for _ in range(6))
            assert bool(re.search(cues.one_pattern(ps), t)) == bool(re.search("|".join(f"(?:{p})" for p in ps), t)), (ps, t)
