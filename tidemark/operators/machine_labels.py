"""Labels proposed by a language model: prompts, calls in chunks, validation, outcomes.

The model itself is a client made once a Python worker from a picklable factory: anything with
``ask(prompt) -> str``.  Offline, :class:`Replay` answers from a table of recorded replies.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lenient_json import lenient_object
from tidemark.functions.text import blank
from tidemark.operators.store import confirmed
from tidemark.schemas import CLASSES, KEY
from tidemark.session import cut

CHUNK = 10
#: Entries of a hash group, within which chunks are numbered.
GROUP = 1000
RULES = f'Label every item with one of: {", ".join(CLASSES)}. Answer with JSON: {{"labels": [{{"entry_id", "entry_type", "label", "reasoning"}}]}}.\n\n'
REPLY = "labels array<struct<entry_id: string, entry_type: string, label: string, reasoning: string>>"


@dataclass
class Settings:
    """Model settings from a mapping (such as the configuration or the environment), each held above its least value."""

    model: str = "replay"
    timeout_s: float = 120.0
    retries: int = 2
    temperature: float = 0.2

    @classmethod
    def of(cls, values: dict) -> Settings:
        def number(key: str, default: float, least: float) -> float:
            try:
                return max(least, float(values.get(key, default)))
            except (TypeError, ValueError):
                return default

        return cls(str(values.get("model") or cls.model), number("timeout_s", 120.0, 1.0), int(number("retries", 2, 0)), number("temperature", 0.2, 0.0))


class Replay:
    """A client that answers from recorded replies by prompt; unknown prompts get an empty object."""

    def __init__(self, replies: dict[str, str]) -> None:
        self.replies = replies

    def ask(self, prompt: str) -> str:
        return self.replies.get(prompt, "{}")


class Refused(Exception):
    """A reply with an HTTP status of failure."""

    def __init__(self, status: int, text: str) -> None:
        super().__init__(f"HTTP {status}: {text[:200]}")
        self.status, self.text = status, text


class HttpClient:
    """A model behind an HTTP endpoint that takes ``{model, temperature, prompt, schema}`` and answers ``{text}``.

    An answer of 400 that speaks of the schema is asked for once more without one, and from then on.
    """

    def __init__(self, url: str, settings: Settings, headers: dict[str, str] | None = None, schema: dict | None = None) -> None:
        self.url, self.settings, self.headers, self.schema = url, settings, headers or {}, schema

    def _send(self, prompt: str) -> str:
        body = {"model": self.settings.model, "temperature": self.settings.temperature, "prompt": prompt} | ({"schema": self.schema} if self.schema else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.settings.timeout_s) as r:
                return str(json.loads(r.read()).get("text") or "")
        except urllib.error.HTTPError as e:
            raise Refused(e.code, e.read().decode("utf-8", "replace")) from e

    def ask(self, prompt: str) -> str:
        try:
            return self._send(prompt)
        except Refused as e:
            if e.status != 400 or not self.schema or "schema" not in e.text.lower():
                raise
            self.schema = None
            return self._send(prompt)


def passing(error: BaseException | None) -> bool:
    """May a call that failed so succeed later? Looked for along the chain of causes: too many requests, a server's failure, a broken connection."""
    met = set()
    while error is not None and id(error) not in met:
        met.add(id(error))
        if isinstance(error, Refused):
            return error.status == 429 or error.status >= 500
        if isinstance(error, (OSError, TimeoutError)):
            return True
        error = error.__cause__ or error.__context__
    return False


def with_retries(ask: Callable[[str], str], retries: int, pause_s: float = 0.5, retry_on: Callable[[BaseException], bool] = passing) -> Callable[[str], str]:
    """A client's call with waits that double; errors that will not pass are raised at once."""

    def call(prompt: str) -> str:
        for i in range(retries + 1):
            try:
                return ask(prompt)
            except Exception as e:
                if i == retries or not retry_on(e):
                    raise
                time.sleep(pause_s * 2**i)
        raise AssertionError

    return call


def prompt_fields() -> dict[str, Column]:
    """What a prompt shows of an entry, nulls as empty."""
    return {c: blank(c) for c in ("title", "description", "content", "source_name", "source_category", "link", "published_date")}


def item_text(number: Column | None = None) -> Column:
    """One entry's block of a prompt; empty lines are left out."""
    f = prompt_fields()
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    head = F.concat(F.lit("Item "), number.cast("string"), F.lit(" - ")) if number is not None else F.lit("")
    first = F.concat(head, F.lit("entry_type: "), F.col("entry_type"), F.lit(", entry_id: "), F.col("entry_id").cast("string"))
    return F.concat_ws("\n", first, line("source", f["source_name"]), line("category", f["source_category"]), line("date", f["published_date"]), line("title", f["title"]), line("description", f["description"]), line("content", f["content"]))


def batch_prompts(entries: DataFrame, persona: str = "", chunk: int = CHUNK) -> DataFrame:
    """``(chunk_id, prompt, keys)``: prompts of up to ``chunk`` entries in key order.

    Numbers within a hash group take the place of one global order, so no task sorts all entries; the number of groups follows the
    number of entries only, so the chunks are the same on any cluster.
    """
    groups = max(1, -(-entries.count() // GROUP))
    g = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in KEY])), 1, 8), 16, 10).cast("long"), F.lit(groups))
    n = F.row_number().over(Window.partitionBy("g").orderBy(*KEY)) - 1
    e = entries.withColumn("g", g).withColumn("n", n)
    e = e.withColumn("chunk_id", F.concat_ws("-", "g", F.floor(F.col("n") / chunk))).withColumn("text", item_text(F.col("n") % chunk + 1))
    rules = F.lit(f"{persona}\n{RULES}".lstrip())
    per = e.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("n", "text", *KEY))).alias("x"))
    return per.select("chunk_id", F.concat(rules, F.array_join(F.transform("x", lambda i: i["text"]), "\n\n")).alias("prompt"), F.transform("x", lambda i: F.struct(*[i[k].alias(k) for k in KEY])).alias("keys"))


def ask(prompts: DataFrame, make_client: Callable[[], object], settings: Settings = Settings()) -> DataFrame:
    """``prompts`` with ``reply`` and ``error``; one client a Python worker, a failing call becomes an error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(make_client().ask, settings.retries)
        for pdf in batches:
            replies, errors = [], []
            for p in pdf.prompt:
                try:
                    replies.append(call(p))
                    errors.append(None)
                except Exception as e:  # reported as the chunk's outcome
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pdf.assign(reply=replies, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", reply string, error string"
    return prompts.mapInPandas(run, schema)


def validation_error(label: Column, reasoning: Column) -> Column:
    """Why a proposed label cannot be used, null if it can."""
    known = F.coalesce(F.lower(F.trim(label)).isin(CLASSES), F.lit(False))
    lead = F.lower(F.trim(label)) == CLASSES[0]
    return F.when(~known, "unknown label").when(lead & (F.trim(blank(reasoning)) == ""), "lead without reasoning")


def parse_replies(replies: DataFrame) -> DataFrame:
    """``(chunk_id, entry_type, entry_id, label, reasoning)`` of what lenient JSON finds in each reply."""
    got = replies.select("chunk_id", F.from_json(lenient_object(F.col("reply")), REPLY).alias("r"))
    x = got.select("chunk_id", F.explode("r.labels").alias("x"))
    return x.select("chunk_id", F.trim("x.entry_type").alias("entry_type"), F.trim("x.entry_id").try_cast("long").alias("entry_id"), F.lower(F.trim("x.label")).alias("label"), "x.reasoning")


def match(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``(key, label, reasoning, outcome)`` of every asked key: ``labeled``, or why not. The first usable answer to a key counts."""
    a = answers.withColumn("problem", validation_error(F.col("label"), F.col("reasoning")))
    w = Window.partitionBy(*KEY).orderBy(F.col("problem").isNotNull(), "label", blank("reasoning"))
    first = a.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*KEY, "label", "reasoning", "problem", F.lit(True).alias("have"))
    j = asked.select(*KEY).distinct().join(first, KEY, "left")
    outcome = F.when(F.col("have").isNull(), "no answer").otherwise(F.coalesce("problem", F.lit("labeled")))
    good = outcome == "labeled"
    return j.select(*KEY, F.when(good, F.col("label")).alias("label"), F.when(good, blank("reasoning")).alias("reasoning"), outcome.alias("outcome"))


def to_retry(matched: DataFrame) -> DataFrame:
    """Keys worth one more call: a lead without a reason, or no answer."""
    return matched.where(F.col("outcome").isin("lead without reasoning", "no answer")).select(*KEY)


def eligible(entries: DataFrame, labels: DataFrame, profile_id: int, replace_own: bool = False) -> DataFrame:
    """Entries with ``skip``: null where a machine label may be set, else why not."""
    mine = labels.where(F.col("profile_id") == profile_id).select(*KEY, F.col("label_source").alias("src"), (~confirmed()).alias("waits"), F.lit(True).alias("have"))
    j = entries.join(mine, KEY, "left")
    own = F.lower(F.trim(blank("src"))) == "gemini"
    skip = F.when(F.col("have").isNull(), None).when(F.col("waits"), "waits for a decision").when(own & F.lit(replace_own), None).otherwise("labelled")
    return j.withColumn("skip", skip).drop("src", "waits", "have")


def outcome_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("outcome").agg(F.count("*").alias("n"))


def run_batch(
    entries: DataFrame, labels: DataFrame, profile_id: int, job: str, now: str, make_client: Callable[[], object], settings: Settings = Settings(), persona: str = "", chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """``(pending label rows, outcome of every entry)``: the eligible entries are asked in chunks, what deserves it once more alone.

    Both calls' answers are written to the shared folder first, so a model is never asked twice because a later stage reruns.
    """
    todo = eligible(entries, labels, profile_id)
    free = todo.where("skip IS NULL").drop("skip")
    first = cut(ask(batch_prompts(free, persona, chunk), make_client, settings))
    answers = parse_replies(first)
    again = free.join(to_retry(match(free, answers)), KEY, "left_semi")
    second = cut(ask(batch_prompts(again, persona, 1), make_client, settings))
    # the answer of the second call counts where there is one
    late = parse_replies(second)
    both = answers.join(late.select(*KEY).distinct(), KEY, "left_anti").select(*late.columns).unionByName(late)
    result = cut(match(free, both))
    skipped = todo.where("skip IS NOT NULL").select(*KEY, F.col("skip").alias("outcome"))
    return pending_labels(result, profile_id, job, now), result.select(*KEY, "outcome").unionByName(skipped)


def pending_labels(matched: DataFrame, profile_id: int, job: str, now: str, source: str = "gemini") -> DataFrame:
    """Label rows that wait under a job for acceptance."""
    return matched.where("outcome = 'labeled'").select(
        F.lit(profile_id).cast("long").alias("profile_id"), *KEY, "label", "reasoning", F.lit(source).alias("label_source"), F.lit(job).alias("pending_job_id"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")
    )
