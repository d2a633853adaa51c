"""Runners around an external model: keys already done are skipped, replies parsed, failures kept."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import jsonish
from spanloom.operators import relational


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def attempted(client: Callable[[str], str], prompt: str, attempts: int = 3, wait: float = 0.0) -> tuple[str | None, str | None]:
    """Reply and error; waits longer before each new attempt."""
    error = None
    for i in range(attempts):
        try:
            return client(prompt), None
        except Exception as e:  # the client's own errors become rows
            error = f"{type(e).__name__}: {e}"
            if wait and i + 1 < attempts:
                time.sleep(wait * (i + 1))
    return None, error


def run(rows: DataFrame, key: str, prompt: str, client: Callable[[str], str], attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """key, raw_response, error: the injected client is called on executors, with retries."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *attempted(client, p, attempts, wait)) for k, p in zip(batch[key], batch[prompt], strict=True)]
            yield pd.DataFrame(out, columns=[key, "raw_response", "error"])

    return rows.select(key, prompt).mapInPandas(call, f"{key} {rows.schema[key].dataType.simpleString()}, raw_response string, error string")


def forward(rows: DataFrame, key: str, prompt: str, client: Callable[[str], str], log: str, attempts: int = 3) -> DataFrame:
    """Calls the client for keys that the log lacks and appends the answers; returns the latest answer
    of every key with parsed and parse_ok. A key whose call failed is tried again next time."""
    spark = rows.sparkSession
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, raw_response string, error string, at long"
    try:
        done = spark.read.schema(schema).json(log)
        known = done.filter("error is null")
    except AnalysisException:
        known = spark.createDataFrame([], schema)
    left = pending(rows, known, key)
    at = known.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0] + 1
    run(left, key, prompt, client, attempts).withColumn("at", F.lit(at)).write.mode("append").json(log)
    every = spark.read.schema(schema).json(log)
    latest = every.groupBy(key).agg(F.max_by(F.struct("raw_response", "error"), F.struct(F.col("error").isNull(), "at")).alias("_r")).select(key, "_r.*")
    return latest.withColumn("parsed", jsonish.parse(F.col("raw_response"))).withColumn("parse_ok", F.col("parsed").isNotNull())


def repaired(answers: DataFrame, key: str, client: Callable[[str], str], instruction: str) -> DataFrame:
    """answers (key, raw_response) with unreadable ones asked again, with an instruction to mend them."""
    bad = jsonish.parse(F.col("raw_response")).isNull()
    again = run(answers.filter(bad).withColumn("_p", F.concat(F.lit(instruction + "\n"), F.coalesce("raw_response", F.lit("")))), key, "_p", client)
    fixed = again.select(key, F.when(jsonish.parse(F.col("raw_response")).isNotNull(), F.col("raw_response")).alias("raw_response"))
    return answers.filter(~bad).select(key, "raw_response", F.lit(False).alias("was_repaired")).unionByName(fixed.select(key, "raw_response", F.col("raw_response").isNotNull().alias("was_repaired")))


class ChatClient:
    """A chat endpoint of the usual shape. token gives a bearer token; it is kept until the endpoint
    refuses it, then asked for once more. opener is replaced in tests."""

    def __init__(self, url: str, model: str, token: Callable[[], str], system: str = "", opener: Callable | None = None, timeout: float = 60.0, **settings):
        self.url, self.model, self.token, self.system, self.opener, self.timeout, self.settings = url, model, token, system, opener, timeout, settings
        self.kept: str | None = None

    def __call__(self, prompt: str) -> str:
        import urllib.error
        import urllib.request

        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, **self.settings}).encode()
        for fresh in (False, True):
            if fresh or self.kept is None:
                self.kept = self.token()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.kept}"})
            try:
                with (self.opener or urllib.request.urlopen)(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read())["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if e.code != 401 or fresh:
                    raise
        raise AssertionError


def induced(client: Callable[[str], str], payload: str, stages: tuple[tuple[str, str], ...], check: Callable[[dict], list[str]]) -> tuple[dict, list[str]]:
    """A schema by stages (name, prompt with {payload} and {previous}), such as induce, critique and
    revise, each given the answer before; and what check finds wrong with the last."""
    previous = ""
    for name, prompt in stages:
        reply, error = attempted(client, prompt.replace("{payload}", payload).replace("{previous}", previous))
        if error:
            raise RuntimeError(f"{name}: {error}")
        previous = reply
    at = previous.find("{")
    found = json.JSONDecoder().raw_decode(previous, at)[0] if at >= 0 else {}
    return found, check(found)


def fold_inputs(inventory: DataFrame, sentences: DataFrame, folds: list[str], fold: str, key: str, by: str, order: str, per_model: int, examples: int, seed: int) -> DataFrame:
    """fold, payload: for each fold a JSON text of the inventory, shortened by model, and of example
    sentences from the other folds, in order of a seeded hash."""
    small = relational.top_per_group(inventory, [by], [F.asc(order)], per_model)
    listed = small.agg(F.array_sort(F.collect_list(F.struct(by, order, *(c for c in small.columns if c not in (by, order))))).alias("inventory"))
    place = F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    others = sentences.select("*", F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col(fold))).alias("_for"))
    chosen = relational.top_per_group(others.withColumn("_o", place), ["_for"], [F.asc("_o"), F.asc(key)], examples)
    given = chosen.groupBy(F.col("_for").alias("fold")).agg(F.array_sort(F.collect_list(F.struct("_o", *(c for c in sentences.columns)))).alias("examples"))
    return given.crossJoin(listed).select("fold", F.to_json(F.struct("inventory", "examples")).alias("payload"))  # one row a fold


def dictionary_prompt(inventory: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """One prompt text a group: its lines in order."""
    return inventory.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, line)))[line], "\n").alias("prompt"))


def backward(forward: DataFrame, key: str, evidence: str, client: Callable[[str], str]) -> DataFrame:
    """Rows without evidence get a blank reconstruction and no call."""
    some = F.coalesce(F.trim(evidence), F.lit("")) != ""
    blank = forward.filter(~some).select(key, F.lit("").alias("raw_response"), F.lit(None).cast("string").alias("error"))
    return run(forward.filter(some), key, evidence, client).unionByName(blank)
