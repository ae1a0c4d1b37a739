"""Passes of a language model over records: prompts with caps, calls with budget and retries, and answers kept to their shape.

The client is given: any picklable function of a list of prompts that returns a
list of texts.  A pass keeps a table of what is done, a folder a run, so a run
that ends early is gone on with: answered items are not asked again, failed ones
are.  Prompts are cut in columns before anything is sent, so a task holds a
batch of bounded prompts; a session of any length gives its first messages only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.embed import Embedder, embedded
from ..functions.text import strip_ws

# fixed values: messages and characters that go into a prompt, items and characters that stay of an answer
SESSION_MESSAGES, SESSION_CHARS, TALK_MESSAGES, TALK_CHARS, EXCHANGE_CHARS, MEMORY_CHARS = 40, 600, 30, 800, 500, 2000
SUMMARY_CHARS, POINTS, POINT_CHARS, TITLE_CHARS = 400, 3, 160, 100
PAIRS, PAIR_CHARS, DECISIONS, DECISION_CHARS = 5, 200, 3, 200
EMPTY_SESSION = "(empty session)"

Client = Callable[[list[str]], list[str]]


def transcripts(messages: DataFrame, most: int = SESSION_MESSAGES, chars: int = SESSION_CHARS) -> DataFrame:
    """(session, text) of messages (session, pos, role, text): `role: text` lines of the first messages, each text cut."""
    first = messages.withColumn("_k", F.row_number().over(Window.partitionBy("session").orderBy("pos"))).filter(F.col("_k") <= most)
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    joined = first.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("_k", line.alias("line")))).alias("ls"))  # `most` messages
    text = F.array_join(F.transform("ls", lambda s: s["line"]), "\n")
    return joined.select("session", F.when(text == "", EMPTY_SESSION).otherwise(text).alias("text"))


def numbered(texts: Column, chars: int = MEMORY_CHARS) -> Column:
    """A batch of texts as one prompt part: `[i] text`, each cut with an ellipsis."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("…"))).otherwise(t))), "\n\n")


def session_summary(answer: Column) -> Column:
    """summary, decisions and next_steps of an answer that holds a JSON object, cut to their caps; null if it holds none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "summary string, decisions array<string>, next_steps array<string>")
    points = lambda c: F.slice(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), lambda p: F.substring(p, 1, POINT_CHARS)), 1, POINTS)
    out = F.struct(F.substring(F.coalesce(found["summary"], F.lit("")), 1, SUMMARY_CHARS).alias("summary"), points(found["decisions"]).alias("decisions"), points(found["next_steps"]).alias("next_steps"))
    return F.when(found.isNotNull(), out)


def capped_items(answer: Column, items: int, chars: int) -> Column:
    """The first objects of an answer that holds a JSON array, values cut; plain strings become {text: ...}; others don't count."""
    raw = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<string>")
    one = lambda s: F.when(s.startswith("{"), F.from_json(s, "map<string,string>")).otherwise(F.create_map(F.lit("text"), s))
    cut = lambda m: F.transform_values(m, lambda _, v: F.substring(v, 1, chars))
    return F.filter(F.transform(F.slice(F.coalesce(raw, F.array().cast("array<string>")), 1, items), lambda s: cut(one(s))), lambda m: m.isNotNull())


def plain_title(answer: Column) -> Column:
    """Without quotes and blanks around it, cut; null if nothing is left."""
    title = F.substring(F.regexp_replace(strip_ws(answer), r"""^["']+|["']+$""", ""), 1, TITLE_CHARS)
    return F.when(title != "", title)


def called(rows: DataFrame, client: Client, retries: int = 2) -> DataFrame:
    """(id, answer, error) of rows (id, prompt): a batch is one call; if it fails its prompts are tried one by one, each 1 + retries times."""

    def single(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(1 + retries):
            try:
                return client([prompt])[0], None
            except Exception as e:  # noqa: BLE001  what a client raises is its answer
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf["prompt"].tolist()
            try:
                answers = client(prompts)
                if len(answers) != len(prompts):
                    raise ValueError("another number of answers")
                told = [(a, None) for a in answers]
            except Exception:  # noqa: BLE001
                told = [single(p) for p in prompts]
            yield pd.DataFrame({"id": pdf["id"], "answer": pd.Series([a for a, _ in told], dtype=object), "error": pd.Series([e for _, e in told], dtype=object)})

    return rows.select("id", "prompt").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, answer string, error string")


@dataclass
class Pass:
    """A pass and its table of answers in `path`; budget: prompts of a run at most, those of the smallest ids first (0: all)."""

    spark: SparkSession
    path: str
    client: Client
    budget: int = 0
    retries: int = 2

    def _runs(self) -> int:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system, n = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), 0
        while system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={n}/_SUCCESS")):
            n += 1
        return n

    def _table(self, n: int, id_type: str) -> DataFrame:
        schema = f"id {id_type}, answer string, error string"
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/run={k}" for k in range(n)])

    def run(self, items: DataFrame) -> DataFrame:
        """(id, answer) of items (id, prompt) answered so far, after one more run."""
        n, id_type = self._runs(), items.schema["id"].dataType.simpleString()
        done = self._table(n, id_type).filter("error is null").select("id")
        left = items.filter("prompt is not null").join(done, "id", "left_anti")
        if self.budget:
            left = left.orderBy("id").limit(self.budget)
        called(left, self.client, self.retries).write.mode("overwrite").parquet(f"{self.path}/run={n}")
        return self._table(n + 1, id_type).filter("error is null").select("id", "answer")

    def failures(self, id_type: str = "long") -> DataFrame:
        """(id, errors) of items that no run has answered."""
        rows = self._table(self._runs(), id_type)
        return rows.groupBy("id").agg(F.count("error").alias("errors"), F.count(F.when(F.col("error").isNull(), 1)).alias("ok")).filter("ok = 0").select("id", "errors")


def retitled(memories: DataFrame, answers: DataFrame, embedder: Embedder, dim: int | None = None) -> DataFrame:
    """(id, title, vector) of records (id, content) with a title among answers (id, answer): the vector is that of title, blank line and content; of another length than dim it is no result."""
    rows = memories.select("id", "content").join(answers, "id").select("id", plain_title(F.col("answer")).alias("title"), "content").filter("title is not null")
    whole = rows.withColumn("content", F.concat("title", F.lit("\n\n"), F.coalesce("content", F.lit(""))))
    out = embedded(whole, embedder).select("id", "title", "vector")
    return out.filter(F.size("vector") == dim) if dim else out
