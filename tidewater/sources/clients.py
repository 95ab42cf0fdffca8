"""Calls to outside models as an injectable client, with an offline stand-in, and resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A client takes (prompt, seed) and gives (output, prompt tokens, output tokens, finish reason).
Client = Callable[[str, int], tuple[str, int, int, str]]


def echo_client(prompt: str, seed: int) -> tuple[str, int, int, str]:
    """Deterministic stand-in: the prompt's last line."""
    output = prompt.strip().rsplit("\n", 1)[-1]
    return output, len(prompt.split()), len(output.split()), "STOP" if output else "EMPTY"


def answer(tasks: DataFrame, client: Client = echo_client) -> DataFrame:
    """``key, output, prompt_tokens, output_tokens, finish, error`` for tasks (key, prompt, seed), in Arrow batches; a failing call is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt, seed in zip(pdf.key, pdf.prompt, pdf.seed, strict=True):
                try:
                    rows.append((key, *client(prompt, int(seed)), None))
                except Exception as e:  # the outside world: recorded, and retried by the next run
                    rows.append((key, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["key", "output", "prompt_tokens", "output_tokens", "finish", "error"])
            yield out.astype({"prompt_tokens": "Int64", "output_tokens": "Int64"})

    return tasks.select("key", "prompt", "seed").mapInPandas(run, "key string, output string, prompt_tokens long, output_tokens long, finish string, error string")


def pending(tasks: DataFrame, receipts: DataFrame) -> DataFrame:
    """Tasks without a successful receipt; failed ones are tried again."""
    return tasks.join(receipts.where(F.col("error").isNull()).select("key"), "key", "left_anti")
