"""Correction, summary and quiz steps around a language model that the caller injects.

A client is a picklable function from a list of messages to text. It runs in ``mapInPandas``, a row a call;
guards, packing, validation and fallbacks are columns, so a model's failure never loses a page.
"""

from __future__ import annotations

import json
import sys
import urllib.request
from collections.abc import Callable
from http.client import HTTPException

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, script, text
from . import documents, prompts
from .prompts import message

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def instructed(messages: Column, shared: str = prompts.SHARED) -> Column:
    """The shared instruction at the end of the first system message, or as one in front."""
    systems = F.filter(F.transform(messages, lambda m, i: F.struct(m["role"].alias("r"), i.alias("i"))), lambda x: x["r"] == "system")
    at = F.get(systems, F.lit(0))["i"]
    added = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, F.concat(m["content"], F.lit(shared))).otherwise(m["content"]).alias("content")))
    return F.when(at.isNotNull(), added).otherwise(F.concat(F.array(message("system", F.lit(shared.strip()))), messages))


def ask(rows: DataFrame, client: Callable[[list[dict]], str], column: str = "messages", into: str = "output", *, grounded: bool = False, table: dict[str, str] | None = None) -> DataFrame:
    """The rows with the client's answer, its script converted; a failed call gives null, which the guards replace.

    Rows without messages are not asked and have null too.
    Every call carries the shared instruction, ``grounded`` ones also the one against unsupported content.
    """
    schema = rows.drop(column).withColumn(into, F.lit(None).cast("string")).schema

    def run(batches):
        for pdf in batches:
            said = []
            for m in pdf[column]:
                try:
                    said.append(None if m is None else client([{"role": x["role"], "content": x["content"]} for x in m]))
                except (OSError, ValueError, LookupError, HTTPException):  # no answer, or one of another form
                    said.append(None)
            yield pdf.drop(columns=[column]).assign(**{into: pd.Series(said, dtype=object)})

    shared = prompts.SHARED + (prompts.GROUNDED if grounded else "")
    out = rows.withColumn(column, instructed(F.col(column), shared)).mapInPandas(run, schema)
    return out.withColumn(into, script.to_traditional(text.strip_artifacts(F.col(into)), table))


def correct(pages: DataFrame, client: Callable | None, *, most: int = 1000, evidence: DataFrame | None = None, reconstruct: bool = True) -> DataFrame:
    """stem, text to stem, corrected_text, used_llm: clean, chunk, ask, guard each chunk, join in order, rebuild the whole.

    ``evidence`` (stem, regions; a row a stem): its prompts with alternatives stand for the chunks of a page that
    has any. The whole first pass is asked for once more, kept within 0.65 to 1.65 of its length.
    """
    clean = pages.select("stem", text.normalize_noise(F.col("text")).alias("clean"))
    if client is None:
        return clean.select("stem", F.col("clean").alias("corrected_text"), F.lit(False).alias("used_llm"))
    parts = F.transform(documents.chunks(F.col("clean"), most), lambda c: F.struct(c.alias("prompt_text"), c.alias("fallback_text")))
    if evidence is not None:
        clean = clean.join(evidence.select("stem", documents.evidence_chunks(F.col("regions")).alias("seen")), "stem", "left")
        parts = F.when(F.size("seen") > 0, F.col("seen")).otherwise(parts)
    parts = clean.withColumn("parts", parts).select("stem", F.size("parts").alias("count"), F.posexplode_outer("parts").alias("index", "x")).select("stem", "index", F.col("x.prompt_text").alias("prompt"), F.col("x.fallback_text").alias("source"), "count")
    parts = parts.withColumn("messages", prompts.correction(F.coalesce("prompt", F.lit("")), F.coalesce("index", F.lit(0)) + 1, F.greatest("count", F.lit(1)))).drop("count")
    out = ask(parts, client, grounded=True).withColumn("kept", metrics.guarded(F.col("output"), F.col("source"), F.col("source")))
    whole = out.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "kept"))), lambda x: x["kept"]), "\n").alias("t"), F.max(F.coalesce(F.col("output") == F.col("kept"), F.lit(False))).alias("used_llm"))
    if reconstruct:
        whole = whole.withColumn("t", text.strip(F.col("t")))
        again = ask(whole.withColumn("messages", prompts.reconstruction(F.col("t"))), client, grounded=True).withColumn("kept", metrics.guarded(F.col("output"), F.col("t"), F.col("t"), 0.65, 1.65))
        whole = again.select("stem", F.col("kept").alias("t"), (F.col("used_llm") | F.coalesce(F.col("output") == F.col("kept"), F.lit(False))).alias("used_llm"))
    return whole.select("stem", text.normalize_noise(F.col("t")).alias("corrected_text"), "used_llm")


def summarize(pages: DataFrame, client: Callable | None, *, evidence: DataFrame | None = None) -> DataFrame:
    """stem, text to stem, summary and its validation messages; without a client the deterministic summary.

    ``evidence`` (stem, statistics, uncertain; a row a stem): a quality note goes before the text that a client
    sees, with unknown counts where a page has no evidence.
    """
    clean = pages.select("stem", text.normalize_noise(F.col("text")).alias("clean"))
    if client is None:
        out = clean.select("stem", documents.fallback_summary(F.col("clean")).alias("summary"))
    else:
        note = F.lit(None).cast("string")
        if evidence is not None:
            clean = clean.join(evidence.select("stem", "statistics", "uncertain"), "stem", "left")
            counts = [F.col("statistics")[k] for k in ("raw_candidate_count", "merged_region_count", "high_confidence_region_count")]
            clean = clean.select("stem", "clean", text.quality_context(*counts, F.coalesce("uncertain", F.lit(0))).alias("note"))
            note = F.col("note")
        asked = clean.withColumn("messages", prompts.summary(note, F.col("clean")))
        out = ask(asked, client).select("stem", documents.normalize_summary(F.coalesce("output", F.lit(""))).alias("summary"))
    return out.withColumn("validation_errors", documents.validate_summary(F.col("summary")))


def quiz(summaries: DataFrame, client: Callable | None, *, count: int = 5, repairs: int = 2) -> DataFrame:
    """stem, summary to stem, quiz and messages: two calls, then up to two repairs of missing sections."""
    src = summaries.select("stem", documents.quiz_source(F.col("summary")).alias("source"))
    if client is None:
        out = src.select("stem", documents.fallback_quiz(F.col("source"), count).alias("quiz"))
        return out.withColumn("validation_errors", documents.validate_quiz(F.col("quiz"), count))
    names = (*documents.QUESTIONS, *documents.ANSWERS)
    parts = src.withColumn("parts", F.create_map().cast("map<string,string>"))
    for k in range(2 + repairs):
        wanted = {0: names[:2] + names[3:5], 1: (names[2], names[5])}.get(k, names)
        lacking = F.array_except(F.array(*map(F.lit, wanted)), F.map_keys("parts"))
        wording = {0: prompts.objective_questions(F.col("source"), count), 1: prompts.short_questions(F.col("source"), count)}.get(k, prompts.quiz_repair(F.col("source"), lacking, count))
        asked = parts.withColumn("messages", F.when(F.size(lacking) > 0, wording))
        # one chain of plans, so that no call is made twice: complete rows pass through unasked
        heard = ask(asked, client).withColumn("new", documents.normalize_quiz(F.coalesce("output", F.lit("")), names))
        fresh = F.map_filter("new", lambda n, _: ~F.map_contains_key("parts", n))
        parts = heard.select("stem", "source", F.map_concat("parts", fresh).alias("parts"))
    whole = F.map_concat(F.map_from_arrays(F.array_except(F.array(*map(F.lit, names)), F.map_keys("parts")), F.transform(F.array_except(F.array(*map(F.lit, names)), F.map_keys("parts")), lambda _: F.lit(""))), "parts")
    out = parts.select("stem", documents.assemble_quiz(whole, whole).alias("quiz"))
    return out.withColumn("validation_errors", documents.validate_quiz(F.col("quiz"), count))


def http_client(endpoint: str, model: str, *, key: str | None = None, timeout: int = 90, retry_limit: int = 16384) -> Callable[[list[dict]], str]:
    """Client of a chat endpoint, local (…/api/chat) or of the widespread completions form.

    A local answer cut for length is asked once more with a doubled budget.
    """
    local = endpoint.rstrip("/").endswith("/api/chat")

    def call(messages: list[dict], budget: int = 8192) -> str:
        body = {"model": model, "messages": messages, "stream": False} | ({"options": {"num_predict": budget}} if local else {})
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(endpoint, json.dumps(body).encode(), head), timeout=timeout) as r:
            got = json.load(r)
        if not local:
            return got["choices"][0]["message"]["content"]
        if got.get("done_reason") == "length" and budget * 2 <= retry_limit:
            return call(messages, budget * 2)
        return got["message"]["content"]

    return call
