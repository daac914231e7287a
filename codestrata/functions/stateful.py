"""Order-dependent state per key, exact in batch and without one task per key.

Rows are cut into ranges of (key, time). Only the first key of a range can continue the
range before it, so what crosses ranges is one small state each. Ranges first run with an
empty state; those that turn out to start from another state run again, until nothing
changes. A gap longer than the state's life ends the dependence, so few rounds are needed;
the result is exact for any number. Each range streams through its task in sorted batches,
so memory does not grow with the size of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ordered import chunked

State = list[int]
# (state, time, extra values) -> (new state, output values)
Step = Callable[[State, int, tuple], tuple[State, tuple]]


def _walk(batches: Iterator[pd.DataFrame], key: str, ts: str, extra: list[str], step: Step, carried: dict[int, State],
          outputs: list[str] | None, live: Callable[[State, int], State]) -> Iterator[pd.DataFrame]:
    chunk = first = current = None
    state: State = []
    start = end = 0
    for pdf in batches:
        keys, times = pdf[key].tolist(), pdf[ts].tolist()
        extras = list(zip(*[pdf[c].tolist() for c in extra])) if extra else [()] * len(keys)
        produced = []
        for k, t, e in zip(keys, times, extras):
            if chunk is None:
                chunk, first, start = int(pdf["_chunk"].iloc[0]), k, int(t)
                current, state = k, list(carried.get(chunk, []))
            elif k != current:
                current, state = k, []
            state, out = step(state, int(t), e)
            end = int(t)
            if outputs is not None:
                produced.append(out)
        if outputs is not None and len(keys):
            yield pdf.drop(columns=["_chunk"]).assign(**{n: [p[i] for p in produced] for i, n in enumerate(outputs)})
    if outputs is None and chunk is not None:
        yield pd.DataFrame({"_chunk": [chunk], "first_key": [str(first)], "last_key": [str(current)], "start": [start], "end": [end], "state": [state]})


def ordered_scan(df: DataFrame, key: str, ts: str, tie: str, extra: list[str], step: Step, live: Callable[[State, int], State],
                 outputs: dict[str, str], chunks: int | None = None) -> DataFrame:
    """Run ``step`` over the rows of each key in (ts, tie) order and add ``outputs``.

    ``live(state, t)`` is the part of a state that still matters at time ``t``.
    """
    base = chunked(df, [key], [ts, tie], chunks)
    summary_schema = "_chunk int, first_key string, last_key string, start bigint, end bigint, state array<bigint>"

    def summarise(rows: DataFrame, carried: dict[int, State]) -> dict[int, dict]:
        ordered = rows.sortWithinPartitions(key, ts, tie)
        out = ordered.mapInPandas(lambda it: _walk(it, key, ts, extra, step, carried, None, live), summary_schema)
        # one row per range, so the driver holds as many rows as there are partitions
        return {r["_chunk"]: r.asDict() for r in out.collect()}

    info = summarise(base, {})
    carried: dict[int, State] = {}
    while True:
        stale = []
        prev = None
        for c in sorted(info):
            want: State = []
            if prev is not None and info[prev]["last_key"] == info[c]["first_key"]:
                want = live(list(info[prev]["state"]), info[c]["start"])
            if want != carried.get(c, []):
                carried[c] = want
                if info[c]["first_key"] == info[c]["last_key"]:
                    stale.append(c)
            prev = c
        if not stale:
            break
        info.update(summarise(base.where(F.col("_chunk").isin(stale)), carried))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_chunk"]
    schema = ", ".join(fields + [f"{n} {t}" for n, t in outputs.items()])
    names = list(outputs)
    return base.sortWithinPartitions(key, ts, tie).mapInPandas(lambda it: _walk(it, key, ts, extra, step, carried, names, live), schema)
