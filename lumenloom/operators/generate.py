"""Texts made by a model, asked row by row, again if it fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def generated(df: DataFrame, request: str, model: Callable[[], Callable[[str], str]], out: str, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``df`` with ``out``, the model's answer to each request.

    ``model`` makes an answering function once a task. A call that fails is made again, up to ``attempts``
    times in all, after pauses that double each time; what fails every time gives a null, so one bad
    request doesn't lose its batch. Null requests give null and aren't asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = model()
        for batch in batches:
            made = [ask(answer, r, attempts, pause) for r in batch.column(batch.schema.get_field_index(request)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{shape}, `{out}` string")


def ask(answer: Callable[[str], str], request: str | None, attempts: int, pause: float) -> str | None:
    if request is None:
        return None
    for attempt in range(attempts):
        try:
            return answer(request)
        except Exception:  # noqa: BLE001 - whatever a model raises, it is asked again
            if attempt + 1 < attempts:
                time.sleep(pause * 2**attempt)
    return None
