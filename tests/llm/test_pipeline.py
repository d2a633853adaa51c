"""The pipeline's stages, each against plain Python on its own input."""

import random
import zlib

import pytest

import corpus_pipeline
from spanloom.llm import quality_qda
from tests.llm.test_brute import within_one
from tests.llm.test_near_copies import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(tmp_path, spark):
    rng = random.Random(21)
    words = ["g%d" % i for i in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(("!!!", "#$%", "@@", "buy")) for _ in range(n))
    items = [prose(30) for _ in range(6)] + ["what is the name of it"]
    texts = [prose(rng.randint(60, 200)) for _ in range(60)] + [junk(rng.randint(60, 120)) for _ in range(20)]
    for i in range(12):  # near copies of the first texts
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], prose(40) + " " + items[0] + " " + prose(40), prose(50) + " what is the name of it " + prose(20)]
    shared = "a line of menu text that repeats on every page"
    texts += [prose(70) + "\n" + shared + "\n" + prose(10) for _ in range(4)] + [None, "", "two words"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 80), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return items


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_by_hand(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    items = tables(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    scored = {r["doc_id"]: r["predicted"] for r in quality_qda.score(docs, labels).collect()}
    before, left = rows(docs), rows(kept)
    assert set(left) == {i for i in before if scored[i]}
    assert not any(60 <= i < 80 for i in left) and sum(i < 60 for i in left) > 50

    lined = corpus_pipeline.lines(spark, kept, sf)
    assert lined.columns == docs.columns
    first, expected = [], {}
    for i in sorted(left):
        out = []
        for raw in (left[i] or "").split("\n"):
            w = tuple(raw.lower().split())
            if not w or not (w in first or len(w) >= 6 and any(len(u) >= 6 and within_one(w, u) for u in first)):
                out.append(raw)
            if w and w not in first:
                first.append(w)
        expected[i] = None if left[i] is None else "\n".join(out)
    after = rows(lined)
    assert after == expected and after != left

    single = corpus_pipeline.near_duplicates(spark, lined, sf)
    assert single.columns == docs.columns
    group = components([(i, t) for i, t in sorted(after.items())])
    alone = rows(single)
    assert set(alone) == {i for i in after if group[i] == i} and len(alone) < len(after)

    clean = corpus_pipeline.decontaminate(spark, single, sf)
    assert clean.columns == docs.columns
    leaks = {i for i, t in alone.items() if any(x in (t or "") for x in items)}
    assert len(leaks) == 2 and set(rows(clean)) == set(alone) - leaks

    packed = corpus_pipeline.packing(spark, clean, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held = {}
    for i, t in rows(clean).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in packed if p["doc_id"] == i)
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert mine == [(k, 4096 * k, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for k, c in enumerate(cut)]
    for p in packed:
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(p["length"] for p in packed) // 4096)

    whole = corpus_pipeline.run(spark, sf)
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()} == {(p["doc_id"], p["piece"], p["ids_crc32"]) for p in packed}


def test_line_stage_keeps_columns_of_any_name(spark):
    line = "the same line of seven words here\n"
    docs = spark.createDataFrame([(1, line + "first", "en", "s", 1, "kept", ["a"]), (2, line + "second", "en", "s", 1, None, None)], "doc_id long, text string, lang string, source string, n_chars long, n_lines string, removed_lines array<string>")
    got = sorted(corpus_pipeline.lines(spark, docs, "").collect())
    assert corpus_pipeline.lines(spark, docs, "").schema == docs.schema
    assert [(r["doc_id"], r["text"], r["n_chars"], r["n_lines"], r["removed_lines"]) for r in got] == [(1, line + "first", len(line) + 5, "kept", ["a"]), (2, "second", 6, None, None)]


@pytest.mark.parametrize("empty", [("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    for name, schema, row in (("documents", "doc_id long, text string, lang string, source string, n_chars long", (1, "one text of it", "en", "s", 14)), ("labels", "doc_id long, quality int, toxic int", (1, 1, 0)), ("benchmark", "item_id long, text string", (1, "another text"))):
        spark.createDataFrame([] if name in empty else [row], schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in got] == ([] if "documents" in empty else [1])
