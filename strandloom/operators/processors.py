"""Count processors: what looks at every k-mer and its counts in one pass, with a state of its own.

A chain of processors sees the counts batch by batch, in the tasks that hold them. Each processor may drop k-mers
(those after it in the chain do not see them) and keeps a state for its partition; states of partitions are merged
in a tree, some at a time, until one is left. A task that is lost is run again from its rows, so nothing is counted
twice. Only states are shuffled: their size is the processor's, not the table's."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from strandloom.operators.iterate import cut, drop

#: States that one task merges.
FAN = 16


class CountProcessor:
    """One's own processor: override what it needs. ``merge`` must not depend on the order of partitions."""

    name = "processor"

    def begin(self) -> Any:
        """The state of a partition without rows."""
        return None

    def process(self, state: Any, kmers: pa.Array, counts: np.ndarray) -> tuple[Any, np.ndarray | None]:
        """The state after a batch (``counts``: a row for each k-mer, a column for each bank) and which k-mers go on
        along the chain (None: all)."""
        return state, None

    def merge(self, a: Any, b: Any) -> Any:
        return a

    def finish(self, state: Any) -> dict[str, int]:
        """The figures of the whole table."""
        return {}


class Totals(CountProcessor):
    """Distinct k-mers, occurrences, and the greatest of both."""

    def __init__(self, name: str = "totals"):
        self.name = name

    def begin(self):
        return {"distinct": 0, "occurrences": 0, "most": 0}

    def process(self, state, kmers, counts):
        sums = counts.sum(axis=1)
        return {"distinct": state["distinct"] + len(sums), "occurrences": state["occurrences"] + int(sums.sum()), "most": max(state["most"], int(sums.max(initial=0)))}, None

    def merge(self, a, b):
        return {"distinct": a["distinct"] + b["distinct"], "occurrences": a["occurrences"] + b["occurrences"], "most": max(a["most"], b["most"])}

    def finish(self, state):
        return state


class Solid(CountProcessor):
    """Drops k-mers whose sum over the banks is outside a range, and counts both kinds."""

    def __init__(self, least: int, most: int = 2**31 - 1, name: str = "solid"):
        self.least, self.most, self.name = least, most, name

    def begin(self):
        return np.zeros(2, np.int64)

    def process(self, state, kmers, counts):
        sums = counts.sum(axis=1)
        keep = (sums >= self.least) & (sums <= self.most)
        return state + [keep.sum(), (~keep).sum()], keep

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return {"solid": int(state[0]), "weak": int(state[1])}


class Histogram(CountProcessor):
    """k-mers for each sum, and in the last bin all from there on."""

    def __init__(self, bins: int = 10_000, name: str = "histogram"):
        self.bins, self.name = bins, name

    def begin(self):
        return np.zeros(self.bins + 1, np.int64)

    def process(self, state, kmers, counts):
        return state + np.bincount(np.minimum(counts.sum(axis=1), self.bins), minlength=self.bins + 1), None

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return {str(i): int(state[i]) for i in np.flatnonzero(state)}


class SharedBanks(CountProcessor):
    """k-mers for each pair of banks that both have them."""

    def __init__(self, banks: list[str], name: str = "shared"):
        self.banks, self.name = banks, name

    def begin(self):
        return np.zeros((len(self.banks), len(self.banks)), np.int64)

    def process(self, state, kmers, counts):
        there = (counts > 0).astype(np.int64)
        return state + there.T @ there, None

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        n = self.banks
        return {f"{n[i]}-{n[j]}": int(state[i, j]) for i in range(len(n)) for j in range(i, len(n))}


def _partition(chain: list[CountProcessor], columns: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [p.begin() for p in chain]
        for b in batches:
            kmers = b.column("kmer")
            counts = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
            for i, p in enumerate(chain):
                states[i], keep = p.process(states[i], kmers, counts)
                if keep is not None and not keep.all():
                    kmers, counts = kmers.filter(pa.array(keep)), counts[keep]
                if not len(kmers):
                    break
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(chain)), pa.int32()), "part": pa.array([part] * len(chain), pa.int64()), "state": pa.array([pickle.dumps(s) for s in states], pa.binary())})

    return task


def _merged(chain: list[CountProcessor]):
    def task(states: pd.DataFrame) -> pd.DataFrame:
        p = chain[int(states["i"].iloc[0])]
        held = [pickle.loads(s) for s in states.sort_values("part")["state"]]
        out = held[0]
        for s in held[1:]:
            out = p.merge(out, s)
        return pd.DataFrame({"i": states["i"].iloc[:1], "part": states["part"].iloc[:1] // FAN, "state": [pickle.dumps(out)]})

    return task


def process_in_chain(counts: DataFrame, *chain: CountProcessor) -> DataFrame:
    """(processor, key, value): the figures of each processor of a chain over ``counts`` (kmer and a column for each
    bank; null counts are zeros). Names must differ. A table without rows gives the figures of the first states."""
    names = [p.name for p in chain]
    if len(set(names)) < len(names):
        raise ValueError(f"processors of one name: {names}")
    spark, chain = counts.sparkSession, list(chain)
    columns = [c for c in counts.columns if c != "kmer"]
    rows = counts.select("kmer", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    kind, parts = "i int, part bigint, state binary", {"parts": F.max("part")}
    table = cut(rows.mapInArrow(_partition(chain, columns), kind), **parts)
    while (table.measured["parts"] or 0) > 0:
        merged = cut(table.groupBy("i", F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(_merged(chain), kind), **parts)
        drop(table)
        table = merged
    states = {x.i: pickle.loads(x.state) for x in table.collect()}  # one for each processor
    drop(table)
    out = [(p.name, k, int(v)) for i, p in enumerate(chain) for k, v in p.finish(states.get(i, p.begin())).items()]
    return spark.createDataFrame(out, "processor string, key string, value bigint")
