"""Workbooks, reports, stages with resume, collections of files, model stages."""

import os
import time
import zipfile
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanloom.operators import evaluation, models, stages
from spanloom.sources import files, workbook


def test_workbook_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(i, f"text {i} <&\">\x01", i / 4, [i] if i % 2 else None) for i in range(500)], "id long, `a note` string, x double, l array<int>").repartition(5)
    two = spark.createDataFrame([("b", None), ("a", 2)], "k string, v int")
    path = str(tmp_path / "report.xlsx")
    workbook.write_workbook(spark, {"First/one": (one, [F.desc("id")]), "first_one": (two, [F.asc("k")]), "empty": (two.limit(0), [F.asc("k")])}, path)
    rows = files.workbooks(spark, path).orderBy("sheet", "row").collect()
    by = {s: [r["cells"] for r in rows if r["sheet"] == s] for s in {r["sheet"] for r in rows}}
    assert sorted(by) == ["First_one", "first_one_2"]
    assert by["first_one_2"] == [["k", "v"], ["a", "2"], ["b"]]
    wanted = [["id", "a note", "x", "l"]] + [[str(i), f"text {i} <&\"> ", str(i / 4), *([f"[{i}]"] if i % 2 else [])] for i in reversed(range(500))]
    assert by["First_one"] == wanted
    assert [r["row"] for r in rows if r["sheet"] == "First_one"] == list(range(1, 502))
    assert os.listdir(tmp_path) == ["report.xlsx"] and zipfile.ZipFile(path).testzip() is None
    with pytest.raises(ValueError, match="no table"):
        workbook.write_workbook(spark, {"x": (two.limit(0), [])}, path)


def test_failed_workbook_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "bad.xlsx")
    rows = spark.range(200).repartition(4).select(F.lit(0).alias("sheet"), F.col("id").alias("number"), F.when(F.col("id") < 150, F.array(F.lit("x"))).otherwise(F.array(F.raise_error(F.lit("broken")).cast("string"))).alias("cells"))
    spark.dataSource.register(workbook.WorkbookSink)
    with pytest.raises(PySparkException):
        rows.write.format(workbook.FORMAT).mode("overwrite").option("path", path).option("sheets", '[{"name": "s", "columns": ["c"], "numeric": [false], "rows": 200}]').save()
    assert os.listdir(tmp_path) == []


def test_html_report(spark, tmp_path):
    cards = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(30)], "k int, h string").repartition(4)
    files.write_html(cards, "h", [F.desc("k")], str(tmp_path / "out"), "A & B")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.startswith("<!doctype html>") and "<h1>A &amp; B</h1>" in text and text.endswith("</body></html>")
    assert text.index("<p>29</p>") < text.index("<p>2</p>") < text.index("<p>0</p>")


def test_stages_resume_where_something_changed(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)
    broken = [True]

    def first(s, given):
        calls.append("first")
        return given["rows"].withColumn("x", F.col("id") * 2)

    def second(s, given, add):
        calls.append("second")
        if broken[0]:
            raise RuntimeError("killed")
        return given["first"].select((F.col("x") + add).alias("y"))

    def third(s, given):
        calls.append("third")
        return given["second"].agg(F.sum("y").alias("total"))

    made = lambda add=1, version="1": [stages.Stage("first", first, paths={"rows": source}), stages.Stage("second", second, ("first",), options={"add": add}, version=version), stages.Stage("third", third, ("second",))]
    assert [state for _, state in stages.run(spark, made(), root, dry_run=True)[1]] == ["due"] * 3 and calls == []
    with pytest.raises(RuntimeError, match="killed"):
        stages.run(spark, made(), root)
    half = stages.plan(spark, made(), root)[1][1]
    spark.range(3).write.parquet(half)  # what a killed write leaves has no mark
    os.remove(f"{half}/_SUCCESS")
    broken[0] = False
    calls.clear()
    frames, report = stages.run(spark, made(), root)
    assert calls == ["second", "third"] and dict(report) == {"first": "kept", "second": "made", "third": "made"}
    assert frames["third"].first()["total"] == 100
    calls.clear()
    assert stages.run(spark, made(), root)[0]["third"].first()["total"] == 100 and calls == []
    assert stages.run(spark, made(add=2), root)[0]["third"].first()["total"] == 110 and calls == ["second", "third"]
    calls.clear()
    time.sleep(0.01)
    spark.range(1).write.mode("append").parquet(source)
    assert stages.run(spark, made(), root)[0]["third"].first()["total"] == 101 and calls == ["first", "second", "third"]
    with pytest.raises(ValueError, match="unknown inputs"):
        stages.plan(spark, made()[1:], root)


def test_globs_and_collected_results(spark, tmp_path):
    for sub, head, row in (("a/x", "split,f1", "s1,0.5"), ("a", "split,f1", "s2,0.25"), ("b/c/d", "split,auroc", '"s,3",0.75')):
        (tmp_path / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / sub / "metrics_by_split.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "a" / "other.csv").write_text("z\n1\n")
    found = files.collected(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")], {"metrics": "metrics_*.csv", "thresholds": "threshold*.csv"})
    assert sorted(found) == ["metrics"] and found["metrics"].columns[0] == "artifact"
    got = {(r["artifact"].split(tmp_path.name)[1], r["split"], r["f1"], r["auroc"]) for r in found["metrics"].collect()}
    assert got == {("/a/x/metrics_by_split.csv", "s1", "0.5", None), ("/a/metrics_by_split.csv", "s2", "0.25", None), ("/b/c/d/metrics_by_split.csv", "s,3", None, "0.75")}
    t = str(tmp_path)
    names = [p.split(tmp_path.name)[1] for p in files.resolve_paths(spark, f"{t}/a/*.csv, {t}/none/x.csv\n{t}/a/other.csv,{t}/{{a,b/c}}/*/*.csv,{t}/*.nothing")]
    assert names == ["/a/metrics_by_split.csv", "/a/other.csv", "/none/x.csv", "/a/other.csv", "/a/x/metrics_by_split.csv", "/b/c/d/metrics_by_split.csv", "/*.nothing"] or names.count("/a/other.csv") == 1


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        open(f"{log}/load-{os.getpid()}-{time.time_ns()}", "w").close()

        def encoder(texts):
            open(f"{log}/batch-{time.time_ns()}-{len(texts)}-{sum(map(len, texts))}", "w").close()
            return [[float(len(t)), 1.0] for t in texts]

        return encoder

    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(400)] + [(400, None), (401, "y" * 5000)], "k int, t string").repartition(8)
    got = {r["k"]: r["embedding"] for r in models.encoded(df, "t", load, rows=64, most_bytes=600).collect()}
    assert got == {i: [float(i % 50), 1.0] for i in range(400)} | {400: [0.0, 1.0], 401: [5000.0, 1.0]}
    names = os.listdir(log)
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    assert len(loads) == len(set(loads)) <= 8
    for n, size in (map(int, x.split("-")[2:]) for x in names if x.startswith("batch")):
        assert n <= 64 and (size <= 600 or n == 1)


def test_embedding_and_entailment_features(spark):
    df = spark.createDataFrame([(1, "abc", "ab"), (2, None, "x"), (3, "same", "same")], "k int, a string, b string")
    got = {r["k"]: r for r in models.embedding_features(df, "a", "b", lambda: lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]).collect()}
    assert got[1]["embedding_cosine"] == pytest.approx((6 + 1) / (10 * 5) ** 0.5) and got[2]["embedding_cosine"] == 0 and got[3]["embedding_distance"] == pytest.approx(0)
    scorer = lambda pairs: [(0.1, 0.2, 0.7) if len(p) >= len(q) else (0.6, 0.3, 0.1) for p, q in pairs]
    rows = {r["k"]: r for r in models.entailment_features(df, "a", "b", lambda: scorer, labels=("CONTRADICTION", "NEUTRAL", "ENTAILMENT")).collect()}
    r = rows[1]
    assert (r["nli_entail_o2r"], r["nli_contra_o2r"], r["nli_neutral_o2r"], r["nli_entail_r2o"], r["nli_contra_r2o"], r["nli_neutral_r2o"], r["nli_min_bidirectional_entail"], r["nli_max_contradiction"]) == (0.7, 0.1, 0.2, 0.1, 0.6, 0.3, 0.1, 0.6)
    assert rows[3]["nli_min_bidirectional_entail"] == 0.7
    assert models.embedding_frame(models.embedding_features(df, "a", "b", lambda: lambda t: [[1.0]] * len(t)), "k").columns == ["k", "embedding_cosine", "embedding_distance"] and models.embedding_frame(df, "k") is None


def test_scores_of_three_kinds_and_hybrid_sets(spark):
    df = spark.createDataFrame([(i, float(i % 10), "ab"[i % 3 % 2], ("good fine" if i % 2 else "bad poor") + f" w{i % 5}", i % 2) for i in range(80)], "id int, length_ratio double, modal_orig string, t string, y int")
    sets = models.feature_sets(df, [], text="t")
    assert sets["hybrid"] == (["length_ratio"], ["modal_orig"], "t") and sets["text_only"] == ([], [], "t")
    for kind in ("lr", "svc", "linear"):
        scored = evaluation.fit_score(df, df, kind, *sets["hybrid"][:2], text="t")
        m = evaluation.metrics(scored, []).first()
        assert m["accuracy"] == 1.0 and m["auroc"] == 1.0, kind
        s = [r["score"] for r in scored.collect()]
        assert kind == "linear" or (min(s) > 0 and max(s) < 1)
    with pytest.raises(ValueError, match="missing"):
        evaluation.fit_score(df, df.drop("t"), "lr", [], [], text="t")
    metrics, kept = models.experiments({"all": (df, df)}, {"hybrid": sets["hybrid"]}, ["linear"], thresholds=True)
    by = {(r["feature_set"], r["model"]): r["accuracy"] for r in metrics.collect()}
    assert by["hybrid", "linear"] == 1.0 and ("none", "majority") in by and kept.count() == 8


def test_texts_of_all_splits_are_counted_in_one_reading(spark):
    words = "alpha beta gamma delta eps zeta eta theta".split()
    texts = {i: None if i == 7 else " ".join(words[(i * j + j * j // 3) % (2 + i % 7)] for j in range(i % 13)) + " x" * (i % 2) for i in range(90)}
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(k):
        seen.add(1)
        return texts[k]

    df = spark.range(90).repartition(3).select("id", (F.col("id") % 3 == 1).cast("int").alias("y"), F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("part"), read.asNondeterministic()("id").alias("t"))
    schemes = {"leave": F.col("part")}
    tests = {f"leave_{v}": F.coalesce(F.col("part") == v, F.lit(False)) for v in (0, 1)}
    counted = evaluation.term_counts(df, "y", tests, "t", features=9)
    assert seen.value == 90 and "t" not in counted.columns
    frames = evaluation.split_frames(counted, "y", schemes)
    assert sorted(frames) == sorted(tests)

    def terms(i):
        w = [x for x in (texts[i] or "").split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    rows = {r["id"]: r["t_counts"] for r in counted.collect()}
    tops = {}
    for v in (0, 1):
        n = Counter(t for i in range(90) if i % 11 == 0 or i % 2 != v for t in terms(i))
        tops[v] = sorted(n, key=lambda t: (-n[t], " " in t, t))[:9]
    assert any(" " in t for t in tops[0] + tops[1]) and tops[0] != tops[1]
    vocabulary = sorted({*tops[0], *tops[1]}, key=lambda t: (" " in t, t))
    for i, vector in rows.items():
        assert list(vector.toArray()) == [terms(i).count(t) for t in vocabulary], i
    for v in (0, 1):
        slicer = evaluation.count_stages(frames[f"leave_{v}"][0], "t_counts", "out", 9)[0]
        assert [vocabulary[j] for j in slicer.getIndices()] == sorted(tops[v], key=vocabulary.index)


def test_scores_from_counts_are_those_from_texts(spark):
    df = spark.createDataFrame([(i, float(i % 10), f"good w{i % 7} fine w{i % 4}" if i % 3 else f"bad poor w{i % 5}", int(i % 3 > 0) if i % 8 else 1 - int(i % 3 > 0), i % 2) for i in range(120)], "id int, length_ratio double, t string, y int, part int")
    schemes = {"leave": F.col("part")}
    tests = evaluation.split_tests(df, "y", schemes)
    plain, counted = (evaluation.split_frames(x, "y", schemes, tests) for x in (df, evaluation.term_counts(df, "y", tests, "t")))
    for name in tests:
        a, b = ({r["id"]: r["score"] for r in evaluation.fit_score(*frames[name], "lr", ["length_ratio"], [], "y", text).collect()} for frames, text in ((plain, "t"), (counted, "t_counts")))
        assert len(a) == 60 and b == pytest.approx(a, abs=1e-4), name
    results, kept = models.experiments(counted, {"hybrid": (["length_ratio"], [], "t_counts")}, ["lr"], thresholds=True)
    assert [(r["split"], r["model"], r["n"]) for r in results.orderBy("split", "model").collect()] == [(f"leave_{v}", m, 60) for v in (0, 1) for m in ("lr", "majority")] and kept.count() == 16
    assert evaluation.term_counts(df.withColumn("t", F.lit(None).cast("string")), "y", tests, "t").first()["t_counts"].size == 1
