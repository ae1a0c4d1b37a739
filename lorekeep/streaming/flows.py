"""Structured Streaming: feedback, spool, jobs, rate limits, error-fix pairing and edit groups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

from ..functions.text import ACTION_CONFIDENCE, is_error, is_test_pass, micros, skip_command, skip_file

MAX_ATTEMPTS, MAX_AGE_DAYS, MAX_FAILURES = 8, 14, 5
RECENT_ERRORS, FIX_DISTANCE, EDIT_CHANGES, EDIT_IDLE = 5, 3, 10, 2  # fixed values


def fan_out(saves: DataFrame) -> DataFrame:
    """Save events with 200-character snippets; rows that were duplicates are told as well."""
    return saves.select("id", "type", "project", F.substring("content", 1, 200).alias("snippet"), "duplicate")


def unique_feedback(stream: DataFrame, key: str = "key", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events once for each key, within the watermark where they stream; events without a key all pass."""
    if stream.isStreaming:
        stream = stream.withWatermark(ts, delay)
    keyed, others = stream.filter(F.col(key).isNotNull()), stream.filter(F.col(key).isNull())
    once = keyed.dropDuplicatesWithinWatermark([key]) if stream.isStreaming else keyed.dropDuplicates([key])
    return once.unionByName(others)


def spool_metrics(spool: DataFrame, now: Column) -> DataFrame:
    """One row (queue_size, oldest_age_sec) of spooled rows (queued_at); an empty spool and times to come have age 0."""
    age = F.floor((micros(now) - micros(F.min("queued_at"))) / 1_000_000)
    return spool.agg(F.count("*").alias("queue_size"), F.coalesce(F.greatest(F.lit(0), age), F.lit(0)).cast("long").alias("oldest_age_sec"))


def spool_sources(spool: DataFrame) -> DataFrame:
    """(source, n): source, else memory_source, else unknown; empty names count as none."""
    name = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.when(F.col("memory_source") != "", F.col("memory_source")), F.lit("unknown"))
    return spool.groupBy(name.alias("source")).agg(F.count("*").alias("n"))


def spool_pass(spool: DataFrame, sent_keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(spool, dead letters) after one pass: sent rows go, failed ones count an attempt, 8 attempts or 14 days end it. Copies of a key are kept apart."""
    failed = spool.join(sent_keys.select("key").distinct(), "key", "left_anti").withColumn("attempts", F.col("attempts") + 1)
    old = (micros(now) - micros(F.col("queued_at"))) > MAX_AGE_DAYS * 86_400_000_000
    dead = (F.col("attempts") >= MAX_ATTEMPTS) | old
    return failed.filter(~dead), failed.filter(dead)


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """JSON text with sorted keys, one blank behind separators and ASCII escapes; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=True)
        except ValueError:
            return None

    return payload.map(one)


def spool_key(payload: Column) -> Column:
    """SHA-256 of the payload as canonical JSON text, so the order of its keys and its blanks don't count."""
    return F.sha2(canonical_json(payload), 256)


def job_step(jobs: DataFrame, outcome: DataFrame, batch: int = 10) -> DataFrame:
    """Jobs after one tick: the first pending ones run by outcome (id, ok); failures count and the fifth ends a job."""
    first = jobs.filter("status = 'pending'").orderBy("created_at", "id").limit(batch).select("id")
    ran = outcome.join(F.broadcast(first), "id", "left_semi")  # batch rows
    rows = jobs.join(F.broadcast(ran), "id", "left")
    runs = (F.col("status") == "pending") & F.col("ok").isNotNull()
    attempts = F.when(runs & ~F.col("ok"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(runs & F.col("ok"), "done").when(runs & (attempts >= MAX_FAILURES), "failed").otherwise(F.col("status"))
    return rows.select("id", "created_at", status.alias("status"), attempts.alias("attempts"))


def digest_since(events: DataFrame, ts: Column, event_id: Column) -> DataFrame:
    """Rows behind the cursor (ts, event_id), in order."""
    return events.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id))).orderBy("ts", "event_id")


def classified_actions(actions: DataFrame) -> DataFrame:
    """Add kind and confidence to tool actions (tool, target, response); skipped ones have kind null."""
    skipped = F.when(F.col("tool") == "Bash", skip_command(F.col("target"))).otherwise(skip_file(F.col("target")))
    kind = (
        F.when(skipped, F.lit(None))
        .when((F.col("tool") == "Bash") & is_test_pass(F.col("response")) & ~is_error(F.col("response")), "test_pass")
        .when(F.col("tool") == "Write", "write_source")
        .when(F.col("tool") == "Edit", "edit_group")
        .when(F.col("tool") == "Task", "agent")
    )
    table = F.create_map(*[F.lit(x) for kv in ACTION_CONFIDENCE.items() for x in kv])
    return actions.withColumn("kind", kind).withColumn("confidence", table[F.col("kind")])


class Actions:
    """Session state of tool actions: recent errors, a failing test, open edit groups."""

    def __init__(self, errors=(), failing: bool = False, groups=None, count: int = 0) -> None:
        self.errors, self.failing, self.groups, self.count = [tuple(e) for e in errors], failing, dict(groups or {}), count

    def step(self, tool: str, target: str, response: str, error: bool, passed: bool) -> Iterator[tuple[str, str, str]]:
        """Events (kind, target, detail) that one action completes."""
        self.count += 1
        if error:
            self.errors = [*self.errors, (response[:300], self.count)][-RECENT_ERRORS:]
            self.failing = self.failing or "test" in target.lower()
        elif tool == "Bash" and passed:
            if self.failing:
                yield "test_pass", target, response[:300]
            self.failing = False
        elif tool in ("Edit", "Write"):
            found = self._match(target)
            if found is not None:
                yield "error_fix", target, self.errors.pop(found)[0]
            if tool == "Edit":
                first, n = self.groups.get(target, (self.count, 0))
                self.groups[target] = (first, min(EDIT_CHANGES, n + 1))
        for path, (first, n) in list(self.groups.items()):
            if self.count - (first + n) >= EDIT_IDLE:
                del self.groups[path]
                yield "edit_group", path, str(n)

    def flush(self) -> Iterator[tuple[str, str, str]]:
        for path, (_, n) in self.groups.items():
            yield "edit_group", path, str(n)
        self.groups = {}

    def _match(self, path: str) -> int | None:
        name = path.rsplit("/", 1)[-1].lower()
        stem = name.rsplit(".", 1)[0] or name
        for i, (text, _) in enumerate(self.errors):
            if stem in text.lower() or name in text.lower():
                return i
        near = [i for i, (_, at) in enumerate(self.errors) if self.count - at <= FIX_DISTANCE]
        return near[-1] if near else None


class ActionProcessor(StatefulProcessor):
    """Keyed by session; rows carry a sequence number, as their order in a micro-batch isn't given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("actions", "errors array<struct<text: string, at: int>>, failing boolean, groups map<string, struct<first: int, n: int>>, count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            errors, failing, groups, count = self.state.get()
            a = Actions([tuple(e) for e in errors], failing, {k: tuple(v) for k, v in groups.items()}, count)
        else:
            a = Actions()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.tool == "End":
                out += [(key[0], r.seq, *e) for e in a.flush()]
            else:
                out += [(key[0], r.seq, *e) for e in a.step(r.tool, r.target, r.response, bool(r.error), bool(r.passed))]
        self.state.update((a.errors, a.failing, a.groups, a.count))
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "target", "detail"])

    def close(self) -> None:
        pass


ACTION_OUT = "session string, seq long, kind string, target string, detail string"


def action_events(actions: DataFrame) -> DataFrame:
    """(session, seq, kind, target, detail) of actions (session, seq, tool, target, response), streaming or not."""
    rows = actions.withColumn("error", is_error(F.col("response"))).withColumn("passed", is_test_pass(F.col("response")))
    if actions.isStreaming:
        return rows.groupBy("session").transformWithStateInPandas(ActionProcessor(), ACTION_OUT, "Append", "None")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, out = Actions(), []
        for r in pdf.sort_values("seq").itertuples():
            steps = a.flush() if r.tool == "End" else a.step(r.tool, r.target, r.response, bool(r.error), bool(r.passed))
            out += [(key[0], r.seq, *e) for e in steps]
        return pd.DataFrame(out, columns=["session", "seq", "kind", "target", "detail"])

    return rows.groupBy("session").applyInPandas(run, ACTION_OUT)


def rate_limited(requests: DataFrame, limit: int = 120, window_s: float = 60.0) -> DataFrame:
    """(client, ts, id, allowed): fixed windows that begin with a client's first request; the limit is checked before counting."""

    def run(key, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        start, n, out = None, 0, []
        pdf = pd.concat(list(batches)) if not isinstance(batches, pd.DataFrame) else batches
        for r in pdf.sort_values(["ts", "id"]).itertuples():
            if start is None or (r.ts - start).total_seconds() >= window_s:
                start, n = r.ts, 0
            ok = n < limit
            n += ok
            out.append((key[0], r.ts, r.id, ok))
        return pd.DataFrame(out, columns=["client", "ts", "id", "allowed"])

    return requests.select("client", "ts", "id").groupBy("client").applyInPandas(run, "client string, ts timestamp_ntz, id long, allowed boolean")


def not_done(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items of a checkpointed backfill that are still to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")
