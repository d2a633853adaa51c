"""Walks through JSON against plain recursive Python."""

import json
import random
import re

from pyspark.sql import functions as F

from spanloom.operators import diagnostics, evidence, walks


def value(rng, depth):
    kind = rng.randrange(9 if depth else 5)
    if kind < 5:
        return [rng.choice(["x y", " two  spaces ", "", "é\n\"q\"", "[1]", '{"id": 3}']), rng.randrange(99), None, rng.random() < 0.5, 2.5][kind]
    if kind < 7:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = ["id", "Label", "name", "span", "text", "Unmatched Spans", "not_covered", "union_element_id", "span_text", "value", "decision", "other", "parts"]
    return {k: value(rng, depth - 1) for k in rng.sample(keys, rng.randrange(6))}


def objects(x, path=""):
    if isinstance(x, dict):
        yield path, x
        for k, v in x.items():
            yield from objects(v, f"{path}.{k}" if path else k)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from objects(v, f"{path}[{i}]")


def shown(v):
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (dict, list)) else "" if v is None else str(v)


def first(o, keys):
    return next((shown(v).strip() for k, v in o.items() if k.lower() in keys and shown(v).strip()), "")


def units(x):
    out = []
    for path, o in objects(x):
        i, label, span = (first(o, keys) for keys in (evidence.ID_KEYS, evidence.LABEL_KEYS, evidence.TEXT_KEYS))
        if i or label or span:
            out.append((i, label or span or i, span or label or i, path))
    return out


def under(x):
    seen, out = [], []
    snake = lambda k: re.sub("[^a-z0-9]+", "_", k.lower()).strip("_")

    def strings(v):
        if isinstance(v, (dict, list)):
            return [s for y in (v.values() if isinstance(v, dict) else v) for s in strings(y)]
        s = " ".join(shown(v).split())
        return [s] if s else []

    for _, o in objects(x):
        for k, v in o.items():
            if snake(k) in diagnostics.UNMATCHED_KEYS:
                seen.append(k)
                out += strings(v)
    return bool(seen), list(dict.fromkeys(out))


def docs(n=150):
    rng = random.Random(9)
    made = [value(rng, 5) for _ in range(n)]
    return [x for x in made if isinstance(x, (dict, list))]


def test_units_of_any_json(spark):
    made = docs()
    rows = [(i, json.dumps(x, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, x in enumerate(made)]
    rows += [(900 + i, t) for i, t in enumerate(["", None, "no json", "[", "{'id': 'py', 'n': None, 'parts': ({'label': True},)}", '{"id": "a", "id": "b"}'])]
    df = spark.createDataFrame(rows * 2, "k long, raw string").repartition(3)
    found = df.distinct().join(evidence.json_units(df, F.col("raw")), walks.text_id(F.col("raw")) == F.col("id")).collect()
    got = {r["k"]: [(u["source_element_id"], u["label"], u["span"], u["path"]) for u in r["units"]] for r in found}
    wanted = {i: units(x) for i, x in enumerate(made) if units(x)} | {904: [("py", "py", "py", ""), ("", "True", "True", "parts[0]")], 905: [("b", "b", "b", "")]}
    assert got == wanted


def test_texts_under_keys(spark):
    made = docs()
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(made)] + [(-1, None), (-2, "{broken")], "k long, raw string")
    got = {r["k"]: (r["available"], r["found"]) for r in walks.under_keys(df, F.col("raw"), diagnostics.UNMATCHED_KEYS).collect()}
    # Python meets an object's matched members before it goes into others; the walk goes by place, so order is compared within equal sets
    assert set(got) == {-2, -1, *range(len(made))} and got[-1] == got[-2] == (False, [])
    for i, x in enumerate(made):
        assert got[i][0] == under(x)[0] and sorted(got[i][1]) == sorted(under(x)[1])
    flat = '{"a": {"unmatched spans": ["z", {"w": "y"}, "z", null, " ", true]}, "Not Covered": "x", "n": 1}'
    r = walks.under_keys(spark.createDataFrame([(flat,)], "raw string"), F.col("raw"), diagnostics.UNMATCHED_KEYS).first()
    assert r["found"] == ["z", "y", "True", "x"]


def test_elements_that_a_mapping_names(spark):
    made = docs()
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(made)], "k long, mapping string")
    inventory = spark.createDataFrame([("99", "Sentence"), ("x y", "span")], "union_element_id string, element_scope string")
    got = sorted((r["k"], r["path"], r["union_element_id"], r["span_text"], r["decision_value"], r["element_kind"]) for r in diagnostics.mapping_records(df, "mapping", inventory).collect())
    clean = lambda v: " ".join(shown(v).split())
    turn = lambda o, *keys: next((clean(o[k]) for k in keys if k in o and clean(o[k])), "")
    wanted = []
    for i, x in enumerate(made):
        for path, o in objects(x):
            if o.get("union_element_id"):
                wanted.append((i, path, shown(o["union_element_id"]), turn(o, "span_text"), turn(o, "value", "decision"), "sentence_level_decision" if o["union_element_id"] == 99 else "span_annotation"))
    assert got == sorted(wanted)


def test_texts_are_made_once(spark):
    """A costly text is evaluated once a row, not in each filter, key and join of a walk."""
    for walk in (lambda d, raw: walks.under_keys(d, raw, diagnostics.UNMATCHED_KEYS), walks.element_mentions):
        calls = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def made(x, calls=calls):
            calls.add(1)
            return x

        df = spark.createDataFrame([(i, '{"not_covered": ["x", %d], "union_element_id": "E"}' % i) for i in range(12)], "k long, raw string")
        assert walk(df, made("raw")).count() == 12 and calls.value == 12, calls.value


def test_plain_json_is_read_in_one_pass(spark, monkeypatch):
    """Texts that Python shows as the JVM does never reach the level walk; floats, escapes, rests and literals do, with the same units."""
    walked, level = [], evidence._level_units
    monkeypatch.setattr(evidence, "_level_units", lambda df, raw: walked.append(df.count()) or level(df, raw))
    plain = ['{"": [{"id": " a ", "Label": null, "parts": {"text": ["x", {"Name": true}], "code": -0}}], "b": {"span": "\u00e9 \\"q\\" \\n"}}', '[{"id": "x", "id": "y"}, [], {"\u212aey": 1, "name": ""}]', "{}", "no json", "", None]
    odd = ['{"id": 1e9, "text": [0.00001, 12345678.5]}', '{"label": ["\\u001f"]}', '{"id": "\\ud800"}', '{"id": "a"} and more', "('x', {'id': None, 'name': 'n'})", '{"id": ' + "9" * 1200 + "}"]
    every = [*plain, *odd]
    df = spark.createDataFrame(list(enumerate(every)), "k long, raw string")
    got = {r["k"]: [tuple(u) for u in r["units"]] for r in evidence.units_beside(df, F.col("raw"), "k").collect()}
    assert walked == [len(odd)]
    wanted = df.join(level(df, F.col("raw")), walks.text_id(F.col("raw")) == F.col("id")).collect()
    assert got == {r["k"]: [tuple(u) for u in r["units"]] for r in wanted} and len(got[0]) == 4 and len(got) >= 5
    walked.clear()
    assert evidence.units_beside(df.filter(F.col("k") < len(plain)), F.col("raw"), "k").count() == 2 and not walked
