"""Streamed responses: the events of a request folded into one answer, in batch and as a stateful stream.

An event has ``request_id, seq, ts, text, thought, usage map, finish, candidates``. Later values win, maps merge by key, text parts are
joined in order without thoughts. A request without a finish reason or complete usage, or with several candidates, is
incomplete and goes to the side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

USAGE = ("prompt", "output", "total")


def last_value(name: str) -> F.Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))


def fold(events: DataFrame) -> DataFrame:
    """One row per request: text, finish, usage, times, whether it is complete, and whether its last event lacked what an earlier one had.

    Aggregates combine before the shuffle but for the parts, whose number one response bounds.
    """
    part = F.when(F.col("text").isNotNull() & (F.col("text") != "") & ~F.coalesce("thought", F.lit(False)), F.struct("seq", "text"))
    rows = events.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "").alias("text"),
        last_value("finish").alias("finish"),
        *(last_value(u).alias(u) for u in USAGE),
        F.count("*").alias("n_events"),
        F.max(F.coalesce("candidates", F.lit(0))).alias("most_candidates"),
        F.max_by(F.struct("prompt", "total", "finish"), "seq").alias("tail"),
        F.min("ts").alias("began"),
        F.max("ts").alias("ended"),
        F.min(F.when(part.isNotNull(), F.col("ts"))).alias("first_text"),
    )
    lacking = F.col("finish").isNull() | F.col("prompt").isNull() | F.col("total").isNull() | ((F.col("text") != "") & F.col("output").isNull()) | (F.col("most_candidates") > 1)
    recovered = ~lacking & (F.col("tail.prompt").isNull() | F.col("tail.total").isNull() | F.col("tail.finish").isNull())
    return rows.withColumns({"complete": ~lacking, "recovered": recovered}).drop("tail")


#: Groups of requests whose state is kept together.
BUCKETS = 1024
STATE = "held string"
OUTPUT = "request_id long, text string, finish string, prompt long, output long, total long, n_events long"
FIELDS = ("finish", "prompt", "output", "total")


def fold_stream(events: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The same fold over a stream, in whatever order and however many micro-batches its events come.

    A request is given out once, when the watermark has passed its last event: until then events can come in between. Parts are
    held with their sequence number, and of each field the value with the largest one; state is one answer per open request.
    Requests are dealt by hash into ``buckets``, whose open requests are one state, so that Python is called by bucket and not by request.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(json.loads(state.get[0])) if state.exists else {}
        watermark, touched = state.getCurrentWatermarkMs(), set()
        for batch in () if state.hasTimedOut else batches:
            for request, seq, ms, text, thought, *values in zip(*(batch[c].tolist() for c in ("request", "seq", "ms", "text", "thought", *FIELDS)), strict=True):
                request = request if isinstance(request, str) else None
                own = held.setdefault(request, {"parts": [], "fields": {}, "n": 0, "last": 0})
                touched.add(request)
                if isinstance(text, str) and not (thought is True or thought == 1.0):
                    own["parts"].append((int(seq), text))
                for name, value in zip(FIELDS, values, strict=True):
                    if not pd.isna(value) and int(seq) >= own["fields"].get(name, (-1, None))[0]:
                        own["fields"][name] = (int(seq), value if isinstance(value, str) else int(value))
                own["n"] += 1
                own["last"] = max(own["last"], int(ms))
        for request in touched:
            held[request]["due"] = max(held[request]["last"], watermark) + 1
        done = [(r, held.pop(r)) for r in [r for r, x in held.items() if r not in touched and x["due"] < watermark]]
        if held:
            state.update((json.dumps(list(held.items())),))
            state.setTimeoutTimestamp(max(min(x["due"] for x in held.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if done:
            text = ["".join(t for _, t in sorted(map(tuple, x["parts"]))) for _, x in done]
            field = {name: [x["fields"].get(name, (0, None))[1] for _, x in done] for name in FIELDS}
            numbers = {name: pd.array(field[name], "Int64") for name in USAGE}
            ids = pd.array([None if r is None else int(r) for r, _ in done], "Int64")
            yield pd.DataFrame({"request_id": ids, "text": text, "finish": pd.Series(field["finish"], dtype=object), **numbers, "n_events": [x["n"] for _, x in done]})

    bucket = F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int")
    rows = events.withWatermark("ts", delay).select(bucket.alias("bucket"), F.col("request_id").cast("string").alias("request"), "ts", F.unix_millis("ts").alias("ms"), "seq", "text", "thought", *FIELDS)
    return rows.groupBy("bucket").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, size: str, delay: str = "1 hour") -> DataFrame:
    """Events and their values by time window and type; late ones wait for ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def backoff(attempt: F.Column) -> F.Column:
    """Seconds before a retry: doubling from 15, at most 120."""
    return F.least(15 * F.pow(F.lit(2.0), attempt), F.lit(120.0))


def transient(error: F.Column) -> F.Column:
    """Whether an error is worth a retry: throttled, a server's fault, a timeout or a lost connection."""
    return F.lower(error).rlike("429|50[0-9]|timed? ?out|connection (reset|aborted|refused)|temporarily unavailable")
