"""Runners with injected clients, sources and sinks, bundles, streams."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from spanloom.functions import cues
from spanloom.operators import evaluation, models, review, roundtrip, schema
from spanloom.sources import files
from spanloom.streaming import resume


class Flaky:
    """Answers with JSON, but fails for one prompt until a file says otherwise."""

    def __init__(self, mark):
        self.mark = str(mark)

    def __call__(self, prompt):
        import os

        if prompt == "bad" and not os.path.exists(self.mark):
            raise ValueError("no answer")
        return json.dumps({"echo": prompt}) if prompt != "text" else "not json"


def test_forward_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "text")], "k int, p string")
    log, mark = str(tmp_path / "log"), tmp_path / "mended"
    first = {r["k"]: (r["parse_ok"], r["error"]) for r in roundtrip.forward(rows, "k", "p", Flaky(mark), log, attempts=2).collect()}
    assert first == {1: (True, None), 2: (False, "ValueError: no answer"), 3: (False, None)}
    mark.write_text("")
    again = {r["k"]: r["parse_ok"] for r in roundtrip.forward(rows, "k", "p", Flaky(mark), log).collect()}
    assert again == {1: True, 2: True, 3: False}
    assert spark.read.json(log).count() == 4  # only the failed key was asked again
    answers = spark.createDataFrame([(1, '{"a": 1}'), (3, "not json"), (4, None)], "k int, raw_response string")
    mended = {r["k"]: (r["raw_response"] is not None, r["was_repaired"]) for r in roundtrip.repaired(answers, "k", lambda p: '{"b": 2}' if "not json" in p else "no", "Mend this.").collect()}
    assert mended == {1: (True, False), 3: (True, True), 4: (False, False)}


def test_chat_client_keeps_and_renews_its_token():
    tokens, seen = iter(["old", "new", "never"]), []

    def opener(request, timeout):
        seen.append(request.headers["Authorization"])
        if len(seen) == 2:
            raise urllib.error.HTTPError(request.full_url, 401, "expired", {}, None)
        said = json.loads(request.data)
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": said["messages"][-1]["content"].upper()}}]}).encode())

    client = roundtrip.ChatClient("http://localhost/chat", "m", lambda: next(tokens), system="s", opener=opener, temperature=0)
    assert [client("one"), client("two"), client("three")] == ["ONE", "TWO", "THREE"]
    assert seen == ["Bearer old", "Bearer old", "Bearer new", "Bearer new"]
    assert roundtrip.attempted(lambda p: 1 / 0, "x", 2, 0.001) == (None, "ZeroDivisionError: division by zero")


def test_induction_in_stages():
    said = []

    def client(prompt):
        said.append(prompt)
        return 'Here: {"fields": [%d]} done' % len(said)

    found, wrong = roundtrip.induced(client, "DATA", (("induce", "Make {payload}"), ("revise", "Mend {previous}")), lambda s: [] if s["fields"] else ["empty"])
    assert found == {"fields": [2]} and wrong == [] and said[1].startswith('Mend Here: {"fields": [1]}')


def test_fold_inputs(spark):
    inventory = spark.createDataFrame([("A", i, f"a{i}") for i in range(5)] + [("B", 0, "b0")], "source_model string, source_order int, name string")
    sentences = spark.createDataFrame([(i, f"s{i}", f"fold_{i % 2}") for i in range(20)], "id int, text string, fold string")
    got = {r["fold"]: json.loads(r["payload"]) for r in roundtrip.fold_inputs(inventory, sentences, ["fold_0", "fold_1"], "fold", "id", "source_model", "source_order", 2, 3, 17).collect()}
    assert set(got) == {"fold_0", "fold_1"}
    assert [e["name"] for e in got["fold_0"]["inventory"]] == ["a0", "a1", "b0"]
    assert len(got["fold_0"]["examples"]) == 3 and all(e["fold"] == "fold_1" for e in got["fold_0"]["examples"])
    prompts = roundtrip.dictionary_prompt(inventory, "source_model", "source_order", "name")
    assert {r["source_model"]: r["prompt"] for r in prompts.collect()} == {"A": "a0\na1\na2\na3\na4", "B": "b0"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n3,\n')
    df = files.csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"x": "int", "y": "string"} and df.count() == 2
    assert files.csv(spark, str(tmp_path / "a.csv"), blank_nulls=True).filter("y = ''").count() == 1
    (tmp_path / "b.jsonl").write_text('{"x": 5, "z": 1}\n')
    both = files.tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.jsonl")])
    assert {"x", "y", "z", "_source_file"} == set(both.columns) and {r["_source_file"].rpartition("/")[2] for r in both.collect()} == {"a.csv", "b.jsonl"}
    lines = [json.dumps({"n": i}) if i % 97 else "broken" for i in range(5000)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.jsonl(spark, str(tmp_path / "long.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["_line_no"] for r in rows) == list(range(1, 5001))
    assert {r["_line_no"] - 1 for r in rows if r["_jsonl_parse_error"]} == {i for i in range(5000) if i % 97 == 0}
    assert [r["_line_no"] for r in files.jsonl(spark, str(tmp_path / "long.jsonl"), "skip", 3).orderBy("_line_no").collect()] == [2, 3]
    (tmp_path / "g.txt").write_text("x" * 50)
    assert files.whole_texts(spark, str(tmp_path / "g.txt"), 20).first()["truncated"]
    files.write_audit(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).first()["s"] == "a"
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["x", "y"]
    files.append_jsonl(df.select("x"), str(tmp_path / "log"))
    files.append_jsonl(df.select("x"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_folds(df.select("x", F.lit("fold_00").alias("fold")), "fold", str(tmp_path / "folds"))
    assert (tmp_path / "folds" / "fold=fold_00").is_dir()
    (tmp_path / "c.json").write_text(json.dumps({"defaults": {"t": 0, "n": 1}, "models": {"m": {"t": 2}}}))
    assert files.config(str(tmp_path / "c.json"), "m") == {"t": 2, "n": 1}
    with pytest.raises(ValueError, match="known"):
        files.config(str(tmp_path / "c.json"), "other")
    (tmp_path / "cues.json").write_text(json.dumps({"cue_groups": {"permission": ["may"]}}))
    assert cues.merged({"permission": ["can"], "actor": ["we"]}, cues.load(str(tmp_path / "cues.json"))) == {"permission": ["may"], "actor": ["we"]}
    (tmp_path / "schema.json").write_text(json.dumps({"fields": [{"field_id": "f1", "name": "one", "definition": "d", "extra": 1}]}))
    assert schema.field_rows(str(tmp_path / "schema.json"), spark).first()["name"] == "one"


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 3, "ab"[i % 2], int(i > 20)) for i in range(60)], "x double, z int, c string, y int")
    model = evaluation.pipeline("lr", ["x"], ["c"]).fit(evaluation.balanced(df))
    models.save_bundle(model, str(tmp_path / "bundle"), numeric=["x"], categorical=["c"], threshold=0.5)
    bundle = models.load_bundle(spark, str(tmp_path / "bundle"))
    scored = models.score_with(bundle, df)
    assert bundle[1]["threshold"] == 0.5 and evaluation.metrics(scored, []).first()["accuracy"] > 0.9
    with pytest.raises(ValueError, match="missing"):
        models.score_with(bundle, df.drop("c"))
    weights = {r["feature"]: r["weight"] for r in models.importances(model, model.transform(df)).collect()}
    assert len(weights) >= 3 and max(weights.values()) > 0
    for kind in ("rf", "gbt"):
        assert evaluation.metrics(evaluation.fit_score(df, df, kind, ["x"], ["c"]), []).first()["accuracy"] > 0.9
    words = spark.createDataFrame([(i, "good fine words" if i % 2 else "bad poor text", i % 2) for i in range(40)], "k int, t string, y int")
    assert evaluation.metrics(models.bag_of_words(words, words, "k", "t"), []).first()["accuracy"] == 1.0
    sets = models.feature_sets(df.withColumnRenamed("x", "token_jaccard").withColumn("embedding_cos", F.lit(0.5)), [])
    assert sets["lexical_similarity"] == (["token_jaccard"], []) and sets["engineered_semantic"][0] == ["token_jaccard", "embedding_cos"]


def test_stream_handles_each_key_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    row = lambda k, t: json.dumps({"k": k, "t": t}) + "\n"
    (source / "a.json").write_text(row(1, "2024-01-01T00:00:00Z") + row(2, "2024-01-01T00:01:00Z") + row(1, "2024-01-01T00:02:00Z"))
    start = lambda: resume.resumable(spark, str(source), "k int, t timestamp", "k", "t", lambda df, _: df.write.mode("append").json(out), str(tmp_path / "state")).awaitTermination(120)
    start()
    (source / "b.json").write_text(row(2, "2024-01-01T00:03:00Z") + row(3, "2024-01-01T00:04:00Z"))
    start()
    assert sorted(r["k"] for r in spark.read.json(out).collect()) == [1, 2, 3]


def test_review_helpers(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("x")).first()["x"]
    assert one(review.wrapped(F.col("t"), 10), t="one two three four") == "one two\nthree four"
    assert one(review.badge("recall", F.col("t")), t=0.5) == "recall: 0.50"
    assert one(review.compact(F.col("t"), 8), t=" a  b c d e f ") == "a b c..."
    assert review.path_list("a.csv, b.csv\na.csv\n c.csv") == ["a.csv", "b.csv", "c.csv"]
    assert review.artifact(spark.range(1), "metrics").columns == ["id", "artifact"]


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/><sheet name="Notes" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Sentence</t></si><si><r><t>La</t></r><r><t>bel</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", sheet('<row r="1"><c r="A1" t="inlineStr"><is><t>a title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>hello</t></is></c><c r="C3"><v>4</v></c></row>'))
        z.writestr("xl/worksheets/s2.xml", sheet('<row r="1"><c r="A1"><v>1</v></c></row>'))
    rows = files.workbooks(spark, str(tmp_path / "b.xlsx"), "^notes$")
    assert [(r["sheet"], r["row"], r["cells"]) for r in rows.orderBy("row").collect()] == [("Data", 1, ["a title"]), ("Data", 2, ["Sentence", "", "Label"]), ("Data", 3, ["hello", "", "4"])]
    assert files.with_headers(rows, ["sentence", "label"]).first()["record"] == {"Sentence": "hello", "Label": "4"}
    files.write_markdown(spark.createDataFrame([("x|y", 1), (None, 2)], "a string, b int"), str(tmp_path / "report"), "Summary")
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()) == "# Summary\n\n| a | b |\n|-|-|\n|  | 2 |\n| x/y | 1 |"


def test_injected_models(spark):
    df = spark.createDataFrame([(1, "abc", "ab"), (2, None, "x")], "k int, a string, b string")
    got = {r["k"]: r["embedding"] for r in models.embedded(df, "a", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    scored = models.entailment(df, "a", "b", lambda pairs: [float(len(p) > len(q)) for p, q in pairs]).orderBy("k").collect()
    assert [(r["nli_min"], r["nli_max"], r["nli_gap"]) for r in scored] == [(0.0, 1.0, 1.0), (0.0, 1.0, 1.0)]
