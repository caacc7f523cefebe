"""Scripts run over rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions import machine
from millrace.session import ship


#: Runs of a task: they take their time by the row, not by the byte, and a file of few bytes has very many.
TASK_RUNS = 5_000


def script_runs(df: DataFrame, key: str, source: str, inputs: list[str], outputs: dict[str, int], budget: int, ticks: int, host: dict | None = None) -> DataFrame:
    """(key, ended, ticks, steps, outputs) of a run of the script `source` for each row, `budget` steps a tick, at most `ticks` of them.

    The columns `inputs` are the first variables of layer 0; outputs maps a column's name to a variable, of which numbers are told as doubles and all else as null."""
    ship(df.sparkSession)
    code = machine.assembled(source)
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "ended", "ticks", "steps", *outputs]

    def run(batches):
        for batch in batches:
            rows = []
            for k, *given in batch.itertuples(index=False, name=None):
                made = machine.Machine(code, [None if x is None or x != x else machine.wrapped(x) if isinstance(x, int) else x for x in given], host)
                n = 0
                while n < ticks and not made.ended:
                    made.tick(budget)
                    n += 1
                found = (made.store[made.place(0, i)] for i in outputs.values())
                rows.append((k, made.ended, n, made.steps, *(None if v is None or isinstance(v, str) else float(v) for v in found)))
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([f"k {kind}, ended boolean, ticks int, steps long", *(f"`{c}` double" for c in outputs)])
    dealt = df.select(key, *inputs).repartition(1 + df.count() // TASK_RUNS)
    return dealt.mapInPandas(run, schema).withColumnRenamed("k", key)
