"""The model layer around evaluation: feature sets, baselines, experiments, importances, bundles, vectors."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators import evaluation, relational, retrieval
from spanloom.operators.paired import paired_tfidf  # noqa: F401
from spanloom.session import stored

LEXICAL = ("token_jaccard", "content_recall", "content_precision", "content_f1", "bigram_recall", "length_ratio")
MAPPING = ("mapping_chars", "n_brackets", "n_parens")
_CUE = ("orig_{g}_count", "recon_{g}_count", "{g}_jaccard", "{g}_missing_count", "{g}_added_count", "{g}_presence_preserved")


def cue_columns(columns: list[str], groups: list[str]) -> list[str]:
    wanted = {p.format(g=g) for g in groups for p in _CUE} | {"modal_category_changed"}
    return sorted(wanted & set(columns))


def feature_sets(df: DataFrame, groups: list[str], lexical=LEXICAL, mapping=MAPPING, categorical=("modal_orig", "modal_recon"), text: str | None = None) -> dict[str, tuple]:
    """name -> (numeric columns, categorical columns) and, where a text belongs to it, its column, of those that the table has; empty sets are left out. With a
    text, hybrid has its sparse vector beside all other columns and text_only that alone."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "boolean") or f.dataType.typeName().startswith("decimal")}
    there = lambda names: [c for c in dict.fromkeys(names) if c in numeric]
    cue, cat = there(cue_columns(df.columns, groups)), [c for c in categorical if c in df.columns]
    lex, comp = there(lexical), there(mapping)
    meaning = there(embedding_columns(df))
    sets = {"lexical_similarity": (lex, []), "mapping_complexity": (comp, []), "dictionary_modal": (cue, cat), "engineered_all": (lex + comp + cue, cat)}
    if meaning:
        sets |= {"semantic": (meaning, []), "dictionary_modal_semantic": (cue + meaning, cat), "engineered_semantic": (lex + comp + cue + meaning, cat)}
    found: dict[str, tuple] = {name: (list(dict.fromkeys(n)), c) for name, (n, c) in sets.items() if n or c}
    if text:
        found |= {"text_only": ([], [], text), "hybrid": (list(dict.fromkeys(lex + comp + cue + meaning)), cat, text)}
    return found


def embedding_columns(df: DataFrame) -> list[str]:
    """Columns of vectors' similarities and of entailment."""
    return [c for c in df.columns if c.startswith(("embedding_", "nli_"))]


def embedding_frame(df: DataFrame, *keys: str) -> DataFrame | None:
    """keys and the columns of :func:`embedding_columns`; None if there are none."""
    found = embedding_columns(df)
    return df.select(*keys, *found) if found else None


def majority(train: DataFrame, test: DataFrame, label: str = "y") -> DataFrame:
    """test with the training set's more frequent class as its score (ties: 1)."""
    best = train.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("score"))
    return test.crossJoin(best)  # one row


def bag_of_words(train: DataFrame, test: DataFrame, key: str, text: str, label: str = "y", kind: str = "lr") -> DataFrame:
    """test with a score of a model over hashed word and bigram TF-IDF."""
    return evaluation.fit_score(train, test, kind, [], [], label, text)


def experiments(splits: dict, sets: dict[str, tuple], kinds: list[str], label: str = "y", thresholds: bool = False, **options) -> DataFrame | tuple[DataFrame, DataFrame]:
    """split, feature_set, model and metrics of every combination, the majority baseline among them; with thresholds
    also a second table: what each threshold retains, with its precision and recall."""
    out, by = [], ["split", "feature_set", "model"]

    def add(df, split, name, kind):
        out.append(stored(df.select(label, "score"), "scored").withColumns({"split": F.lit(split), "feature_set": F.lit(name), "model": F.lit(kind)}))

    for split, (train, test) in splits.items():
        add(majority(train, test, label), split, "none", "majority")
        for name, (numeric, categorical, *rest) in sets.items():
            for kind in kinds:
                add(evaluation.fit_score(train, test, kind, numeric, categorical, label, rest[0] if rest else None, **options), split, name, kind)
    scored = relational.union_all(*out)
    results = evaluation.metrics(scored, by, label)
    return (results, evaluation.retention(scored, by, label=label)) if thresholds else results


def mean_over_splits(results: DataFrame, metrics: list[str]) -> DataFrame:
    return results.groupBy("feature_set", "model").agg(F.count("*").alias("n_splits"), *(F.avg(m).alias(f"mean_{m}") for m in metrics))


def importances(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """feature, weight of the last stage: coefficients or importances, named by the assembler's metadata."""
    last, spark = model.stages[-1], scored.sparkSession
    attributes = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    weights = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return spark.createDataFrame([(names.get(i, str(i)), float(w)) for i, w in enumerate(weights)], "feature string, weight double")


def save_bundle(model: PipelineModel, path: str, **about) -> None:
    """The model, and beside it what it needs to be used: columns, dictionaries, thresholds."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first()["value"])


def score_with(bundle: tuple[PipelineModel, dict], df: DataFrame) -> DataFrame:
    """df with score; the columns that the bundle names must be there."""
    model, about = bundle
    absent = [c for c in [*about.get("numeric", []), *about.get("categorical", [])] if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are missing")
    return evaluation.with_score(model.transform(df)).select(*df.columns, "score")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """df with cluster, by cosine distance."""
    ready = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v")


def reduced(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with vector brought to its k principal directions and unit length."""
    from pyspark.ml.feature import PCA, Normalizer

    ready = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    out = Normalizer(inputCol="_p", outputCol="_n").transform(PCA(k=k, inputCol="_v", outputCol="_p").fit(ready).transform(ready))
    return out.withColumn(vector, vector_to_array("_n")).drop("_v", "_p", "_n")


def top_terms(df: DataFrame, key: str, cluster: str, text: str, stop: list[str], n: int) -> DataFrame:
    """cluster, term, weight: the terms with the highest mean TF-IDF over a cluster's texts."""
    terms = retrieval.grams(df, key, text).filter(~F.exists(F.split("term", " "), lambda t: t.isin(stop)))
    w = retrieval.weights(terms, key).join(df.select(key, cluster), key)
    size = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    mean = w.groupBy(cluster, "term").agg(F.sum("w").alias("_s")).join(size, cluster).select(cluster, "term", (F.col("_s") / F.col("_n")).alias("weight"))
    return relational.top_per_group(mean, [cluster], [F.desc(F.round("weight", 9)), F.asc("term")], n)


def both_ways(forward: Column, backward: Column) -> dict[str, Column]:
    """Columns from two directions of an entailment score."""
    return {"nli_min": F.least(forward, backward), "nli_max": F.greatest(forward, backward), "nli_gap": F.abs(forward - backward)}


def embedded(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], vector: str = "embedding") -> DataFrame:
    """df with vectors from an injected encoder of batches of texts, called on executors."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(texts.fillna("").tolist())))

    return df.withColumn(vector, encode(F.col(text)))


def entailment(df: DataFrame, one: str, other: str, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """df with the score of each direction between two texts, from an injected scorer of batches of
    pairs, and what follows from both."""
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype=float)

    scored = df.withColumns({"nli_forward": score(F.col(one), F.col(other)), "nli_backward": score(F.col(other), F.col(one))})
    return scored.withColumns(both_ways(F.col("nli_forward"), F.col("nli_backward")))


def in_bytes(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Runs (begin, end) of texts of at most so many bytes in all, one text at least."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if i > begin and size + n > most:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    return [*out, (begin, len(texts))] if texts else []


def encoded(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list]], vector: str = "embedding", rows: int = 256, most_bytes: int = 1 << 18) -> DataFrame:
    """df with vectors of a text column. load makes the encoder, once in each worker process; it is called with batches of at
    most so many rows and bytes of text (a longer text is a batch by itself); a null text counts as empty."""

    def prepare():
        encoder = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            plain = ["" if t is None else str(t) for t in texts]
            return np.concatenate([np.asarray(encoder(plain[a:b]), np.float32) for a, b in in_bytes(plain, most_bytes)])

        return predict

    encode = predict_batch_udf(prepare, return_type=T.ArrayType(T.FloatType()), batch_size=rows)
    return df.withColumn(vector, encode(F.coalesce(text, F.lit(""))))


def embedding_features(df: DataFrame, one: str, other: str, load: Callable[[], Callable[[list[str]], list]], **options) -> DataFrame:
    """df with embedding_cosine and embedding_distance of two texts; a vector of no length is at right angles to all."""
    both = encoded(encoded(df, one, load, "_a", **options), other, load, "_b", **options)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(product("_a", "_a") * product("_b", "_b"))
    cosine = F.when(length > 0, product("_a", "_b") / length).otherwise(0.0)
    return both.withColumn("embedding_cosine", cosine).withColumn("embedding_distance", 1 - F.col("embedding_cosine")).drop("_a", "_b")


def entailment_features(df: DataFrame, one: str, other: str, load: Callable[[], Callable[[list[tuple[str, str]]], list]], labels: tuple[str, ...] = ("contradiction", "neutral", "entailment"), rows: int = 256, most_bytes: int = 1 << 18) -> DataFrame:
    """df with the eight entailment features of two texts. load makes the scorer, once in each worker process; it gives each pair
    the probabilities of labels, in their order. Batches are bounded as in :func:`encoded`."""
    place = {k: next((i for i, name in enumerate(labels) if k in name.lower()), default) for k, default in (("entail", 2), ("neutral", 1), ("contrad", 0))}

    def prepare():
        scorer = load()

        def predict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pairs = [(str(x), str(y)) for x, y in zip(a, b, strict=True)]
            return np.concatenate([np.asarray(scorer(pairs[i:j]), np.float64) for i, j in in_bytes([x + y for x, y in pairs], most_bytes)])

        return predict

    score = predict_batch_udf(prepare, return_type=T.ArrayType(T.DoubleType()), batch_size=rows)
    text = lambda c: F.coalesce(c, F.lit(""))
    scored = df.withColumns({"_f": score(text(one), text(other)), "_b": score(text(other), text(one))})
    out = {f"nli_{short}_{way}": F.get(column, F.lit(place[kind])) for way, column in (("o2r", "_f"), ("r2o", "_b")) for short, kind in (("entail", "entail"), ("contra", "contrad"), ("neutral", "neutral"))}
    return scored.withColumns(out).withColumns({
        "nli_min_bidirectional_entail": F.least("nli_entail_o2r", "nli_entail_r2o"), "nli_max_contradiction": F.greatest("nli_contra_o2r", "nli_contra_r2o"),
    }).drop("_f", "_b")
