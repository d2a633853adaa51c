"""Classifier evaluation: folds, metrics, thresholds, models."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, Imputer, NGram, Normalizer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.order import running
from spanloom.operators.relational import numbered
from spanloom.session import discard, stored


def stable_id(*parts: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, n)


def hash_fold(key: Column, n: int) -> Column:
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % n


def round_robin_folds(forms: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Forms in order of a seeded hash, dealt in turn; the order is global, no task sees all forms."""
    order = F.substring(F.sha1(F.concat_ws("|", F.col(key), F.lit(str(seed))).cast("binary")), 1, 12)
    placed = numbered(forms.select(key).distinct(), [order, F.col(key)])
    return placed.select(key, F.format_string("fold_%02d", (F.col("number") % n).cast("int")).alias("fold_id"))


def metrics(scored: DataFrame, by: list[str], label: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, AUROC (rank sum, ties averaged) and average precision.

    Rows of a group with equal scores are aggregated first; sums run over ranges of the distinct scores, so no task sees
    all of a group. Without by, all rows are one group."""
    y, s = F.col(label), F.col(score).cast("double")
    per = scored.filter(y.isNotNull() & s.isNotNull()).groupBy(*by, s.alias("s")).agg(F.sum(y.cast("long")).alias("p"), F.sum((1 - y).cast("long")).alias("q"))
    t = running(per, by, "s", {"tp": "p", "fp": "q"}, descending=True)
    hit = F.col("s") >= threshold
    sums = t.groupBy(*by).agg(
        F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return sums.select(*by, (pos + neg).alias("n"), zero(tp + neg - fp, pos + neg).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, pos).alias("recall"), zero(2 * tp, tp + fp + pos).alias("f1"), F.try_divide(F.col("area"), pos * neg).alias("auroc"), F.try_divide(F.col("ap"), pos).alias("average_precision"))


def retention(scored: DataFrame, by: list[str], score: str = "score", thresholds=(0.5, 0.7, 0.8, 0.9), label: str | None = None) -> DataFrame:
    """n and the retained share at each threshold; with a label also n_retained, precision and recall of what is retained."""
    rows = scored.select(*by, score, *([label] if label else []), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col(score) >= F.col("threshold")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    more = []
    if label:
        good, found = F.col(label) == 1, F.count_if(hit & (F.col(label) == 1))
        more = [F.count_if(hit).alias("n_retained"), zero(found, F.count_if(hit)).alias("precision"), zero(found, F.count_if(good)).alias("recall")]
    return rows.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("retained"), *more)


#: Most splits that models are trained on, and classes that a split is stratified by.
MOST_SPLITS, MOST_CLASSES = 200, 1000


def bounded(df: DataFrame, most: int, what: str) -> list:
    """All rows of a small frame; more than most are an error, found without collecting them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def stratified(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """key, label, test: exactly ceil(share * n) rows are test rows, each class as near to its share as whole
    rows allow (largest remainder, then the larger class, then the lesser label). Rows of a class are taken in order of a seeded hash of the
    key; rows without a label are left out."""
    rows = df.select(key, label).filter(F.col(label).isNotNull())
    counts = [(r[label], r["n"]) for r in bounded(rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label), MOST_CLASSES, "classes")]
    n = sum(c for _, c in counts)
    wanted = -(-round(share * 1_000_000) * n // 1_000_000)
    quota = {y: wanted * c // n for y, c in counts}
    for y, _ in sorted(counts, key=lambda r: (-(wanted * r[1] % n), -r[1], r[0]))[: wanted - sum(quota.values())]:
        quota[y] += 1
    ends, start = [], 0
    for y, c in counts:
        ends.append((y, start + quota[y]))
        start += c
    order = F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    placed = numbered(rows, [F.col(label), order, F.col(key)])
    test = F.col("number") < F.lit(0)
    for y, end in reversed(ends):
        test = F.when(F.col(label) == y, F.col("number") < end).otherwise(test)
    return placed.select(key, label, test.alias("test"))


def fill_order(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, end rank, folds in turn): which fold the groups of a size go to, by their rank in it, if
    groups are dealt from the largest size down, each to the fold with the fewest rows (then the lowest number).

    sizes: (size, number of groups), falling. Within a size s a fold with load q * s + r takes its turn on level q and
    all later ones, in order of r: so folds come in cycles, and a cycle grows only where a level is some fold's first."""
    load, out = [0] * k, []
    for size, n in sizes:
        first = {f: divmod(load[f], size) for f in range(k)}
        levels, rank = sorted({q for q, _ in first.values()}), 0
        for i, level in enumerate(levels):
            active = sorted((f for f in range(k) if first[f][0] <= level), key=lambda f: (first[f][1], f))
            end = n if i + 1 == len(levels) else min(n, rank + (levels[i + 1] - level) * len(active))
            if end > rank:
                out.append((size, rank, end, active))
                for j, f in enumerate(active):
                    load[f] += size * ((end - rank - j + len(active) - 1) // len(active))
            rank = end
    return out


def balanced_folds(df: DataFrame, group: str, n_folds: int) -> DataFrame:
    """group, n_rows, fold (from 1): groups from the largest to the smallest, by value within a size, each to
    the fold with the fewest rows so far. Only the histogram of sizes is on the driver (at most about the root of
    twice the rows); groups never are."""
    sized = stored(df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows")), "group-sizes")
    histogram = [(r["n_rows"], r["n"]) for r in sized.groupBy("n_rows").agg(F.count("*").alias("n")).orderBy(F.desc("n_rows")).collect()]
    begin, at = {}, 0
    for size, n in histogram:
        begin[size], at = at, at + n
    k = min(n_folds, at)
    plan = [(size, begin[size] + a, begin[size] + b, folds) for size, a, b, folds in fill_order(histogram, k)]
    cycles = df.sparkSession.createDataFrame(plan, "size long, first long, end long, folds array<int>")
    placed = numbered(sized, [F.desc("n_rows"), F.asc(group)])
    inside = (F.col("n_rows") == F.col("size")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))
    turn = ((F.col("number") - F.col("first")) % F.size("folds")).cast("int")
    return placed.join(cycles, inside).select(group, "n_rows", (F.get("folds", turn) + 1).alias("fold"))


def split_table(df: DataFrame, label: str, schemes: dict[str, Column]) -> DataFrame:
    """scheme, value, n_train, n_test, trainable: each value of each scheme's column is the test part of one split (a
    null is in none), all other rows its train part; trainable if both parts have both classes."""
    each = F.inline(F.array(*(F.struct(F.lit(s).alias("scheme"), c.cast("string").alias("value")) for s, c in schemes.items())))
    y = F.col(label).cast("long")
    parts = df.filter(F.col(label).isNotNull()).select(y.alias("y"), each).groupBy("scheme", "value").agg(F.count("*").alias("n_test"), F.sum("y").alias("p"))
    whole = parts.groupBy("scheme").agg(F.sum("n_test").alias("n"), F.sum("p").alias("all_p"))
    n_train, p_train = F.col("n") - F.col("n_test"), F.col("all_p") - F.col("p")
    both = lambda p, n: (p > 0) & (p < n)
    return parts.filter("value IS NOT NULL").join(F.broadcast(whole), "scheme").select("scheme", "value", n_train.alias("n_train"), "n_test", (both(F.col("p"), F.col("n_test")) & both(p_train, n_train)).alias("trainable"))  # a row a scheme


def split_tests(df: DataFrame, label: str, schemes: dict[str, Column]) -> dict[str, Column]:
    """scheme_value -> whether a row is in the test part, of every trainable split, in order; a row whose value is null only
    trains. Models are trained on each, so more than MOST_SPLITS are an error."""
    table = split_table(df, label, schemes).filter("trainable").orderBy("scheme", "value")
    return {
        f"{r['scheme']}_{re.sub(r'[^A-Za-z0-9_.-]+', '_', r['value'])[:60]}": F.coalesce(schemes[r["scheme"]].cast("string") == r["value"], F.lit(False))
        for r in bounded(table, MOST_SPLITS, "splits")
    }


def split_frames(df: DataFrame, label: str, schemes: dict[str, Column], tests: dict[str, Column] | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """scheme_value -> (train, test) of the splits of :func:`split_tests`, which may be given."""
    rows = df.filter(F.col(label).isNotNull())
    return {name: (rows.filter(~inside), rows.filter(inside)) for name, inside in (tests or split_tests(df, label, schemes)).items()}


def experiment_splits(df: DataFrame, key: str, label: str, group: str, leave: dict[str, str], n_folds: int = 5, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, dict[str, Column]]:
    """df with its split columns, and the schemes over them: one stratified random split, balanced folds of groups, and one
    split for each value of the columns that are left out in turn (scheme name: column)."""
    random = stratified(df, key, label, share, seed).select(F.col(key).alias("_key"), F.when(F.col("test"), "1").alias("random_split"))
    folds = balanced_folds(df, group, n_folds).select(F.col(group).alias("_group"), F.col("fold").alias("group_fold"))
    out = df.filter(F.col(label).isNotNull())
    out = out.join(random, out[key] == F.col("_key")).drop("_key").join(folds, out[group] == F.col("_group"), "left").drop("_group")
    return out, {"random": F.col("random_split"), "leave_group_fold": F.col("group_fold"), **{name: F.col(c) for name, c in leave.items()}}


def splits(df: DataFrame, label: str, fold: Column, groups: list[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """name -> (train, test): by fold, and leaving out each value of the grouping columns; splits
    whose train or test has one class only are skipped."""
    return split_frames(df, label, {"fold": fold, **{g: F.col(g) for g in groups}})


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: classes count alike. Classes are counted once, at the call."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    weights = stored(counts.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight")), "weights", 1)
    return df.join(F.broadcast(weights), label)  # a row a class


#: Trees of a forest and rounds of boosting; studies that compare with forests of 500 trees and 300 rounds pass trees and rounds.
TREES, ROUNDS = 100, 50
# Fixed value: terms of a text's vocabulary.
TEXT_FEATURES = 5000


def text_stages(text: str, output: str, features: int = TEXT_FEATURES) -> list:
    """TF-IDF of the most frequent words and bigrams, of unit length, as a sparse vector."""
    words, pairs, terms = (f"{text}_{x}" for x in ("words", "pairs", "terms"))
    return [
        SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce(`{text}`, '')), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0) AS `{words}` FROM __THIS__"),
        NGram(n=2, inputCol=words, outputCol=pairs), SQLTransformer(statement=f"SELECT *, concat(`{words}`, `{pairs}`) AS `{terms}` FROM __THIS__"),
        CountVectorizer(vocabSize=features, inputCol=terms, outputCol=f"{text}_counts"), IDF(inputCol=f"{text}_counts", outputCol=f"{text}_idf"), Normalizer(inputCol=f"{text}_idf", outputCol=output),
    ]


def term_counts(df: DataFrame, label: str, tests: dict[str, Column], text: str, features: int = TEXT_FEATURES) -> DataFrame:
    """df without its text, with {text}_counts: how often the row has each word and bigram that is among the most frequent
    of some split's training rows, as a sparse vector, words first. Texts are read for all splits together.

    At equal counts words come before bigrams. So a bigram of a split's vocabulary is more frequent than the last of that
    many words, and so are its two words: only bigrams of such words, fewer than features a split, are counted."""
    word = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    rows = stored(df.withColumn("_words", word).drop(text), "words")
    flags = [(F.col(label).isNotNull() & ~inside).alias(f"_{i}") for i, inside in enumerate(tests.values())]
    sums = [F.count_if(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(flags))]
    top = lambda found, i: found.filter(F.col(f"_{i}") > 0).orderBy(F.desc(f"_{i}"), F.instr("term", " ") > 0, "term").limit(features)
    words = stored(rows.select(*flags, F.explode("_words").alias("term")).groupBy("term").agg(*sums), "word-counts")
    often = F.lit(False)
    for i in range(len(flags)):
        last = top(words, i).agg(F.count("*").alias("n"), F.min(f"_{i}").alias("least")).first()
        often |= F.col(f"_{i}") > (last["least"] if last["n"] == features else 0)
    often = words.filter(often).select("term")
    both = F.inline(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.size("_words")).alias("b")))
    pairs = rows.select(*flags, both).join(F.broadcast(often.select(F.col("term").alias("a"))), "a").join(F.broadcast(often.select(F.col("term").alias("b"))), "b")  # a split's features
    found = stored(words.unionByName(pairs.groupBy(F.concat_ws(" ", "a", "b").alias("term")).agg(*sums)), "term-counts")
    terms = {r["term"] for i in range(len(flags)) for r in top(found, i).select("term").collect()}
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    pair = F.zip_with(F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    ready = rows.withColumn("_terms", F.concat("_words", pair)).drop("_words")
    model = CountVectorizerModel.from_vocabulary(sorted(terms, key=lambda t: (" " in t, t)) or [""], inputCol="_terms", outputCol=f"{text}_counts")
    out = stored(model.transform(ready).drop("_terms"), "counted")
    discard(rows, words, found)
    return out


def count_stages(train: DataFrame, counts: str, output: str, features: int = TEXT_FEATURES) -> list:
    """As :func:`text_stages`, from a column of term counts: of its terms the most frequent of the training rows stay."""
    total = train.select(Summarizer.metrics("sum").summary(F.col(counts)).alias("s")).first()["s"]["sum"].toArray()
    kept = [int(i) for i in np.lexsort((np.arange(len(total)), -total))[:features] if total[i] > 0]
    return [VectorSlicer(inputCol=counts, outputCol=f"{counts}_kept", indices=sorted(kept) or [0]), IDF(inputCol=f"{counts}_kept", outputCol=f"{counts}_idf"), Normalizer(inputCol=f"{counts}_idf", outputCol=output)]


def classifier(kind: str, label: str = "y", rows: int = 100, trees: int = TREES, rounds: int = ROUNDS):
    """lr (penalty 1 / rows, as with C = 1), rf, gbt, svc (margins, no probabilities) or linear (predictions only)."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    made = {
        "lr": lambda: LogisticRegression(maxIter=100, regParam=1 / max(rows, 1), standardization=False, **common),
        "rf": lambda: RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, seed=42, **common),
        "gbt": lambda: GBTClassifier(maxDepth=3, maxIter=rounds, stepSize=0.05, subsamplingRate=0.9, seed=42, **common),
        "svc": lambda: LinearSVC(maxIter=50, regParam=1 / max(rows, 1), standardization=False, **common),
        "linear": lambda: LinearRegression(regParam=1 / max(rows, 1), **common),
    }
    return made[kind]()


def pipeline(kind: str, numeric: list[str], categorical: list[str], label: str = "y", text: str | None = None, rows: int = 100, vector: list | None = None, **options) -> Pipeline:
    """Median imputation, scaling, one-hot encoding, sparse TF-IDF of a text column beside them, and a classifier. vector: other
    stages that make {text}_vector."""
    parts, stages = [], []
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="numeric_raw"), StandardScaler(withMean=True, inputCol="numeric_raw", outputCol="numeric_scaled")]
        parts.append("numeric_scaled")
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", handleInvalid="keep")]
        parts.append(f"{c}_hot")
    if text:
        stages += vector or text_stages(text, f"{text}_vector")
        parts.append(f"{text}_vector")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features"), classifier(kind, label, rows, **options)])


def with_score(scored: DataFrame) -> DataFrame:
    """Adds score: the probability of class 1, else the logistic of the margin, else the prediction."""
    if "probability" in scored.columns:
        return scored.withColumn("score", vector_to_array("probability")[1])
    if "rawPrediction" in scored.columns:
        return scored.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
    return scored.withColumn("score", F.col("prediction").cast("double"))


def fit_model(train: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str = "y", text: str | None = None, **options):
    """The fitted pipeline; numeric columns of other types than double are cast, classes weigh alike. text may also name
    a column of :func:`term_counts`."""
    ready = balanced(train.withColumns({c: F.col(c).cast("double") for c in numeric}), label)
    counted = text and isinstance(train.schema[text].dataType, VectorUDT)
    return pipeline(kind, numeric, categorical, label, text, train.count(), count_stages(train, text, f"{text}_vector") if counted else None, **options).fit(ready)


def fit_score(train: DataFrame, test: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str = "y", text: str | None = None, **options) -> DataFrame:
    """test with a score column; the columns that the model needs are checked first."""
    absent = [c for c in [*numeric, *categorical, *([text] if text else [])] if c not in test.columns]
    if absent:
        raise ValueError(f"columns {absent} are missing")
    model = fit_model(train, kind, numeric, categorical, label, text, **options)
    return with_score(model.transform(test.withColumns({c: F.col(c).cast("double") for c in numeric}))).select(*test.columns, "score")
