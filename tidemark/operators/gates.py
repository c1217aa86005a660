"""Sequential gates over rows in time order: which rows are kept depends on the last kept one.

A gate lets a row through that comes `width` or more after the last kept row, or whose value passes against the last
kept one's. So the last kept row alone decides the next kept one, and the kept rows are a path of such steps. It is
found without walking a symbol from end to end:

1. Rows are cut into buckets of time, none shorter than the width. A row is an exit of its bucket if no later row of
   the bucket passes against it: only exits can be the last kept row at the bucket's end. Exits are few: they lie
   within the width before the end.
2. Each bucket maps every exit of the bucket before, as its entry, to its own exit, following steps in arrays. A row
   further back than one bucket is older than the width, so an entry that passes through a bucket without a kept row is
   the same state whichever row it was.
3. Maps are composed over blocks of FAN buckets, blocks of blocks and so on, then the one real entry goes back down.
4. Each bucket, now with its entry, gives its kept rows.

A task holds one bucket: the rows of a symbol in a time of the width, or about ROWS rows if these need longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared

ROWS, FAN = 4096, 256
#: Entries that are no row: nothing kept yet, and a row that is older than the width in the next bucket.
START, OLD = -2, -1


class Gate:
    """width in microseconds, value: a column, code: its values as numbers, passes(one, many): which of many codes pass against one."""

    def __init__(self, width: int, value: str, code: Callable[[Column], Column], passes: Callable[[float, np.ndarray], np.ndarray]):
        self.width, self.value, self.code, self.passes = width, value, code, passes

    def next(self, t, v, at: int, value: np.ndarray, values: np.ndarray) -> int:
        """The first row from place `at` on that passes against (t, value v), or the number of rows."""
        late, step = int(np.searchsorted(t, v + self.width)), 16
        late = max(late, at)
        while at < late:
            hit = np.flatnonzero(self.passes(value, values[at : min(at + step, late)]))
            if len(hit):
                return at + int(hit[0])
            at, step = at + step, 2 * step
        return late

    def exits(self, t: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Rows against which no later one passes."""
        first = int(np.searchsorted(t, t[-1] - self.width, "right"))
        return np.array([i for i in range(first, len(t)) if self.next(t, t[i], i + 1, values[i], values) == len(t)], np.int64)


def min_flip(minutes: int) -> Gate:
    """A direction passes if it is the last kept one's, or either is null."""
    code = lambda c: F.coalesce(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(0).cast("long"))
    return Gate(minutes * 60_000_000, "direction", code, lambda one, many: (many == one) | (many == 0) | (one == 0))


def cooldown(minutes: int, differ: float) -> Gate:
    """A move passes if it differs enough from the last kept one."""
    return Gate(minutes * 60_000_000, "move", lambda c: c.cast("double"), lambda one, many: np.abs(many - one) >= differ)


def kept(rows: DataFrame, gate: Gate, order: list[str], key: str = "symbol", ts: str = "ts", per: int = ROWS, fan: int = FAN) -> DataFrame:
    """The rows that the gate lets through, of each key in order of ts, then of order; rows without a time are all kept and come before the others."""
    spark, columns = rows.sparkSession, rows.columns
    t = F.unix_micros(ts)
    with shared.scratch(spark) as keep:
        raw = shared.written(rows.withColumn("__t", t).withColumn("__v", gate.code(F.col(gate.value))), "gate-rows")
        a, b, n = raw.agg(F.min("__t"), F.max("__t"), F.count("__t")).first()
        if not n:
            return keep(raw).select(columns)
        width = gate.width * max(1, -(-(b - a) * per // (n * gate.width)))
        timed = raw.where("__t is not null").withColumn("__b", F.floor((F.col("__t") - a) / width))
        places = timed.groupBy(F.col(key).alias("__key"), F.col("__b").alias("__at")).agg(F.count("*").alias("__n"))
        line = W.partitionBy("__key").orderBy("__at")  # a row a bucket
        places = places.withColumn("__pos", F.row_number().over(line).cast("long") - 1).withColumn("__gap", F.coalesce(F.col("__at") - F.lag("__at").over(line) > 1, F.lit(False))).drop("__n")
        on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("__at"))
        timed = shared.written(timed.join(places, on).drop("__b", "__at", "__key").withColumn("__key", F.xxhash64(F.lit(1), key)), "gate-placed")
        sorts = ["__t", *[c for c in order if c != ts]]
        need = list(dict.fromkeys(["__key", "__t", "__v", "__pos", "__gap", *sorts]))

        def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
            """The rows in order, nulls first as Spark sorts, their times and values."""
            table = table.take(pc.sort_indices(table, [(c, "ascending") for c in sorts], null_placement="at_start"))
            return table, table["__t"].to_numpy(), table["__v"].to_numpy()

        def exits(table: pa.Table) -> pa.Table:
            table, at, values = ordered(table)
            i = gate.exits(at, values)
            return pa.table({"__key": table["__key"].take(pa.array(i)), "__pos": pa.array(np.full(len(i), table["__pos"][0].as_py() + 1), pa.int64()), "entry": pa.array(i), "e_t": pa.array(at[i]), "e_v": pa.array(values[i])})

        kind = timed.schema["__v"].dataType.simpleString()
        group = timed.select(need).groupBy("__key", "__pos")
        entries = shared.written(group.applyInArrow(exits, f"__key long, __pos long, entry long, e_t long, e_v {kind}"), "gate-exits")

        def first_of(table, at, values, entry: int, e_t, e_v) -> int:
            """The first kept row of a bucket, or the number of its rows."""
            if entry < 0 or table["__gap"][0].as_py():
                return 0
            return gate.next(at, e_t, 0, e_v, values)

        def states(found: pa.Table) -> list[tuple]:
            return list(zip(*[found[c].to_pylist() for c in ("entry", "e_t", "e_v")], strict=True))

        def maps(table: pa.Table, found: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("key", "pos", "entry", "exit")})
            (table, at, values), out, ends = ordered(table), [], {}
            pos = table["__pos"][0].as_py()
            for entry, e_t, e_v in [*states(found), (OLD if pos else START, None, None)]:
                i, way = first_of(table, at, values, entry, e_t, e_v), []
                last = OLD
                while i < len(at):
                    if i in ends:
                        last = ends[i]
                        break
                    way.append(i)
                    last, i = i, gate.next(at, at[i], i + 1, values[i], values)
                ends |= dict.fromkeys(way, last)
                out.append((table["__key"][0].as_py(), pos, entry, last))
            return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "pos", "entry", "exit"])

        each = entries.groupBy("__key", "__pos")
        steps = shared.written(group.cogroup(each).applyInArrow(maps, "key long, pos long, entry long, exit long"), "gate-maps")
        real = shared.written(path(steps, fan).select(F.col("key").alias("r_key"), F.col("pos").alias("r_pos"), F.col("entry").alias("r_entry")), "gate-path")
        now = real.join(entries, (F.col("r_key") == F.col("__key")) & (F.col("r_pos") == F.col("__pos")) & (F.col("r_entry") == F.col("entry")), "left")
        now = now.select(F.col("r_key").alias("__key"), F.col("r_pos").alias("__pos"), F.col("r_entry").alias("entry"), "e_t", "e_v")

        def chosen(table: pa.Table, found: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table.select(columns)
            (table, at, values), out = ordered(table), []
            i = first_of(table, at, values, *states(found)[0])
            while i < len(at):
                out.append(i)
                i = gate.next(at, at[i], i + 1, values[i], values)
            return table.select(columns).take(pa.array(out, pa.int64()))

        found = timed.groupBy("__key", "__pos").cogroup(now.groupBy("__key", "__pos")).applyInArrow(chosen, rows.schema)
        return keep(shared.written(found.unionByName(raw.where("__t is null").select(columns)), "gate"))


def path(steps: DataFrame, fan: int = FAN) -> DataFrame:
    """key, pos, entry: the entry that the path from START meets at each place; steps: key, pos (0, 1, ...), entry, exit."""

    def followed(table: pd.DataFrame, entry: np.ndarray) -> list[np.ndarray]:
        """The entries at each place of a block, for each entry at its first, and after its last."""
        out, table = [entry], table.sort_values(["pos", "entry"])
        pos = table.pos.to_numpy()
        edges = np.flatnonzero(np.append(True, pos[1:] != pos[:-1])).tolist()
        for a, e in zip(edges, [*edges[1:], len(table)], strict=True):
            keys, ends = table.entry.to_numpy()[a:e], table.exit.to_numpy()[a:e]
            entry = ends[np.searchsorted(keys, entry)]
            out.append(entry)
        return out

    def up(table: pd.DataFrame) -> pd.DataFrame:
        first = np.sort(table.entry[table.pos == table.pos.min()].to_numpy())
        return pd.DataFrame({"key": table.key.iloc[0], "pos": table.pos.iloc[0] // fan, "entry": first, "exit": followed(table, first)[-1]})

    def down(table: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(table) or not len(entry):
            return pd.DataFrame({"key": [], "pos": [], "entry": []})
        found = followed(table, entry.entry.to_numpy()[:1])[:-1]
        return pd.DataFrame({"key": table.key.iloc[0], "pos": np.sort(table.pos.unique()), "entry": [x[0] for x in found]})

    block = F.floor(F.col("pos") / fan).alias("block")
    levels = [steps]
    while levels[-1].agg(F.max("pos")).first()[0]:
        above = levels[-1].groupBy("key", block).applyInPandas(up, "key long, pos long, entry long, exit long")
        levels.append(shared.written(above, "gate-level"))
    real = levels[-1].where(F.col("entry") == START).select("key", "pos", "entry")
    for level in levels[-2::-1]:
        under = level.groupBy("key", block).cogroup(real.groupBy("key", F.col("pos").alias("block"))).applyInPandas(down, "key long, pos long, entry long")
        real = shared.written(under, "gate-entries")
    return real
