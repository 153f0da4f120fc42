"""Rows of a key in order of event time, however they arrive: a buffer in the state store, emptied by event-time timers as the watermark passes.

A state is that of a slice: all keys of one hash. Each call to the state store goes from Python to the JVM and back, so its number must not grow with the keys. A batch reads
and writes the slices that it meets, and holds one at a time; `slices` is fixed for a checkpoint, as the shuffle's partitions are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DataType, FractionalType, IntegralType, LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 1024
NAN = float("nan")


def micros(interval: str) -> int:
    return int(pd.Timedelta(interval).value // 1000)


def keep_state(df: DataFrame) -> None:
    """Timers need the RocksDB state store, which this session's streams then use."""
    df.sparkSession.conf.set(PROVIDER, ROCKSDB)


def plain(v):
    """A cell of a pandas column as the state store takes it: lists for arrays, None for missing numbers."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [plain(x) for x in v]
    return None if v is None or v is pd.NaT or v is pd.NA else v


def one(v):
    """A cell of a key, so that equal ones, NaN included, are one key of a dict."""
    return tuple(map(one, v)) if isinstance(v, list) else NAN if v != v else v


def by_slice(df: DataFrame, keys: list[str], time: str, columns: list[str], delay: str, slices: int) -> DataFrame:
    """slice, time, micros, nulls (a bit for each column), then keys and columns as c0, c1, ...: pandas has no whole numbers beside nulls, so such nulls are sent as 0."""
    names = [*keys, *columns]
    full = lambda n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType)) if isinstance(df.schema[n].dataType, IntegralType) else F.col(n)
    nulls = sum((F.when(F.col(n).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(names)), F.lit(0).cast("long"))
    out = df.select(
        F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int").alias("slice"), F.col(time).alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), nulls.alias("nulls"), *[full(n).alias(f"c{i}") for i, n in enumerate(names)]
    )
    return out.where(F.col("time").isNotNull()).withWatermark("time", delay)


def tuples(part: pd.DataFrame, width: int) -> list[tuple]:
    """Rows of by_slice as (time in microseconds, keys..., columns...)."""
    nulls = part["nulls"].to_numpy().astype("int64")
    columns = []
    for i in range(width):
        column = list(map(plain, part[f"c{i}"].tolist()))
        for at in np.flatnonzero(nulls >> i & 1).tolist():
            column[at] = None
        columns.append(column)
    return list(zip(part["micros"].tolist(), *columns, strict=True))


def packed(rows: Iterable[tuple], width: int) -> list[list]:
    """Rows as columns, for the state."""
    return list(map(list, zip(*rows, strict=True))) or [[] for _ in range(width)]


def frame(rows: list[tuple], names: list[str], kinds: list[DataType]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.array(c, "Int64") if isinstance(k, IntegralType) else list(c) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})


class Slices(StatefulProcessor):
    """One state and at most one timer a slice. `settle`: (state by columns, or None; fresh rows; watermark in microseconds) -> (state by columns, or None; the millisecond of
    the watermark that next changes something, or None; rows out)."""

    def __init__(self, width: int, held: str, names: list[str], kinds: list[DataType]):
        self.width, self.held, self.names, self.kinds = width, held, names, kinds

    def init(self, handle) -> None:
        self.handle, self.state, self.settled = handle, handle.getValueState("slice", f"due long, {self.held}"), set()

    def settle(self, stored: tuple | None, fresh: list[tuple], limit: int) -> tuple[list | None, int | None, list[tuple]]:
        raise NotImplementedError

    def _run(self, key, fresh: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        before, held = (stored[0], tuple(stored[1:])) if stored is not None else (None, None)
        state, due, out = self.settle(held, fresh, watermark_ms * 1000)
        due = None if due is None else max(watermark_ms + 1, due)
        if before is not None and before != due and before > watermark_ms:
            self.handle.deleteTimer(before)
        if due is not None and due != before:
            self.handle.registerTimer(due)
        if state is not None:
            self.state.update((due, *state))
        elif held is not None:
            self.state.clear()
        self.settled.add(int(key[0]))
        if out:
            yield frame(out, self.names, self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [r for part in rows for r in tuples(part, self.width)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if int(key[0]) not in self.settled:  # else the batch's rows have settled it at this watermark
            yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Ordered(Slices):
    """Buffers rows until the watermark has passed them, then hands those of a key in order to `advance`: (state, rows) -> (state, rows out).

    A key that is silent for longer than ttl starts anew, and its state goes once the watermark says so.
    """

    def __init__(self, keys: int, columns: int, held: str, names: list[str], kinds: list[DataType], ties, own: int, start, advance, ttl, odd_keys: bool):
        super().__init__(keys + columns, held, names, kinds)
        self.keys, self.ties, self.own, self.start, self.advance, self.ttl, self.odd_keys = keys, ties, own, start, advance, ttl, odd_keys

    def settle(self, stored, fresh, limit):
        k, width = self.keys, 1 + self.width
        name = (lambda r: tuple(map(one, r))) if self.odd_keys else (lambda r: r)
        groups, own = defaultdict(list), {}
        for r in [*zip(*stored[:width], strict=True), *fresh] if stored else fresh:
            groups[name(r[1 : 1 + k])].append((r[0], *r[1 + k :]))
        if stored:
            own = {name(r[:k]): r[k:] for r in zip(*stored[width:], strict=True)}
        out: list[tuple] = []
        waiting: list[tuple] = []
        due: list[int] = []
        for key, rows in groups.items():
            wait = [r for r in rows if r[0] > limit]
            if wait:
                waiting += [(r[0], *key, *r[1:]) for r in wait]
                due.append(-(-min(r[0] for r in wait) // 1000))
            if len(wait) < len(rows):
                ready = sorted((r for r in rows if r[0] <= limit), key=lambda r: (r[0], *[(r[i] is not None, r[i]) for i in self.ties]))
                *state, last = own[key] if key in own else (*self.start(), None)
                state, made = self._advance(tuple(state), last, ready)
                own[key] = (*state, ready[-1][0])
                out += [(*key, *r) for r in made]
        if self.ttl is not None:
            still = {r[1 : 1 + k] for r in waiting}
            own = {key: s for key, s in own.items() if key in still or s[-1] + self.ttl >= limit}
            due += [(s[-1] + self.ttl) // 1000 + 1 for key, s in own.items() if key not in still]
        if not waiting and not own:
            return None, None, out
        return [*packed(waiting, width), *packed([(*key, *s) for key, s in own.items()], k + self.own)], min(due, default=None), out

    def _advance(self, state: tuple, last: int | None, ready: list[tuple]) -> tuple[tuple, list[tuple]]:
        out: list[tuple] = []
        begin = 0
        for i in range(len(ready) + 1):  # rows between two long silences go together
            before = ready[i - 1][0] if i else last
            if i == len(ready) or self.ttl is not None and before is not None and ready[i][0] - before > self.ttl:
                if i > begin:
                    state, made = self.advance(state, ready[begin:i])
                    out += made
                if i < len(ready):
                    begin, state = i, self.start()
        return state, out


def in_order(
    df: DataFrame, keys: list[str], time: str, delay: str, columns: list[str], ties: list[str], state: str, start: Callable[[], tuple], advance: Callable, made: str, carry: list[str] | None = None, ttl: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """keys, time, carry, made: rows of df in order of time (ties by the columns named), passed on once the watermark, `delay` behind the latest row, has passed them.

    Rows later than that are dropped, and so are rows without a time. columns: what advance gets after the time; state: its fields in DDL; made: its columns in DDL.
    """
    keep_state(df)
    carry = carry or []
    kind = lambda names: ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    used = list(dict.fromkeys([*ties, *carry, *columns]))
    made_fields, own = StructType.fromDDL(made).fields, StructType.fromDDL(state).fields
    lists = lambda prefix, kinds: [f"{prefix}{i} array<{k.simpleString()}>" for i, k in enumerate(kinds)]
    key_kinds, kinds = [df.schema[k].dataType for k in keys], [df.schema[c].dataType for c in used]
    held = ", ".join(["t array<long>", *lists("c", [*key_kinds, *kinds]), *lists("k", key_kinds), *lists("own", [f.dataType for f in own]), "last array<long>"])
    names, out_kinds = [*keys, time, *carry, *[f.name for f in made_fields]], [*key_kinds, LongType(), *[df.schema[c].dataType for c in carry], *[f.dataType for f in made_fields]]
    odd_keys = any(isinstance(k, FractionalType | ArrayType) for k in key_kinds)
    processor = Ordered(len(keys), len(used), held, names, out_kinds, [1 + used.index(c) for c in ties], len(own) + 1, start, advance, None if ttl is None else micros(ttl), odd_keys)
    out = f"{kind(keys)}, `{time}` long, " + "".join(f"{kind([c])}, " for c in carry) + made
    rows = by_slice(df, keys, time, used, delay, slices).groupBy("slice").transformWithStateInPandas(processor, out, "append", "EventTime")
    return rows.withColumn(time, F.timestamp_micros(F.col(time)))
