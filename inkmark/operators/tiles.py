"""A user's own functions on parts of frames: distortions on tiles with a border, metrics as states that merge.

Neither needs a frame to fit into a task: a task sees a tile and its border, or a batch of pixels of any frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB

EDGES = ("edge", "reflect", "constant")
#: States that a task keeps before it passes them on, and groups in which a frame's states are merged first.
HELD, GROUPS = 4096, 32


def tiled_attack(pixels: DataFrame, function: Callable[[np.ndarray], np.ndarray], tile: int = 64, halo: int = 1, edge: str = "edge") -> DataFrame:
    """A function of an array (height, width, 3) of levels, as doubles, to one of the same shape, applied tile by tile.

    The function sees a tile with `halo` more rows and columns on each side. Within a frame these are the neighbours'
    pixels; beyond its edges they repeat the last ones (edge), mirror them (reflect) or are 0 (constant), as for the
    whole frame. What it gives for the border is dropped; levels are clipped and rounded half to even. Where values
    depend on no pixel farther than halo away, the result is that of the function on the whole frame. A tile with
    missing pixels is an error.
    """
    if tile < 1 or not 0 <= halo <= tile:
        raise ValueError("tile must be 1 at least, and halo from 0 to the tile's side")
    if edge not in EDGES:
        raise ValueError(f"unknown edge {edge}")
    near = lambda a: F.expr(f"explode(array_distinct(array({a} div {tile}, greatest(0, {a} - {halo}) div {tile}, ({a} + {halo}) div {tile})))")
    dealt = pixels.select(*KEYS, *RGB).withColumn("__ty", near("y")).withColumn("__tx", near("x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select("carrier_id").schema) + ", y int, x int, r int, g int, b int"

    def run(part: pa.Table) -> pa.Table:
        y, x = (part[c].to_numpy().astype(int) for c in ("y", "x"))
        corner = [part[c][0].as_py() * tile for c in ("__ty", "__tx")]
        low, high = (y.min(), x.min()), (y.max(), x.max())
        core = [range(max(c, a), min(c + tile - 1, b) + 1) for c, a, b in zip(corner, low, high, strict=True)]
        if not all(core):  # the border reaches into a tile that the frame hasn't
            return part.select([*KEYS, *RGB]).slice(0, 0).cast(pa.schema([part.schema.field("carrier_id"), *[pa.field(c, pa.int32()) for c in (*KEYS[1:], *RGB)]]))
        seen = np.full((high[0] - low[0] + 1, high[1] - low[1] + 1, 3), np.nan)
        seen[y - low[0], x - low[1]] = np.column_stack([part[c].to_numpy() for c in RGB])
        if np.isnan(seen).any():
            raise ValueError("a tile lacks pixels")
        more = [(max(0, halo - (c[0] - a)), max(0, c[-1] + halo - b)) for c, a, b in zip(core, low, high, strict=True)]
        seen = np.pad(seen, [*more, (0, 0)], mode=edge)
        out = np.asarray(function(seen))
        if out.shape != seen.shape:
            raise ValueError(f"the function made {out.shape} of {seen.shape}")
        first = [c[0] - a + m[0] for c, a, m in zip(core, low, more, strict=True)]
        out = out[first[0] : first[0] + len(core[0]), first[1] : first[1] + len(core[1])]
        levels = np.rint(np.clip(out, 0, 255)).astype(np.int32).reshape(-1, 3)
        rows, columns = (g.ravel().astype(np.int32) for g in np.meshgrid(*map(np.array, core), indexing="ij"))
        ids = part["carrier_id"].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table([ids, rows, columns, *levels.T], [*KEYS, *RGB])

    return dealt.groupBy("carrier_id", "__ty", "__tx").applyInArrow(run, schema)


@dataclass(frozen=True)
class Mergeable:
    """A metric of two frames as a state that parts of the frames build and that merges, in any order.

    init() is the state of no pixels, an array; update(state, first, second) adds pixels, arrays (n, 3) of levels of
    both frames; merge(state, state) joins two states; finish(state) is the value.
    """

    init: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = field(default=lambda a, b: a + b)


def user_metrics(first: DataFrame, second: DataFrame, metrics: dict[str, Mergeable]) -> DataFrame:
    """(carrier_id, metric, value) of each metric and frame; a place on one side only is an error.

    Tasks build states of the frames that they meet; states of a frame, one for a task, are merged in GROUPS groups
    and then at last. Only states are shuffled.
    """
    second_levels = second.select(*KEYS, *[F.col(c).alias(f"d{c}") for c in RGB])
    joined = first.select(*KEYS, *RGB).join(second_levels, list(KEYS), "full_outer")
    lacks = F.col("r").isNull() | F.col("dr").isNull()
    both = joined.select("carrier_id", F.when(lacks, F.raise_error(F.lit("frames differ in size")).cast("int")).otherwise(F.col("r")).alias("r"), "g", "b", *[f"d{c}" for c in RGB])
    kind = both.schema["carrier_id"].dataType.simpleString()
    schema = f"carrier_id {kind}, metric string, part int, state array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, part, ids = {}, 0, None

        def flushed() -> pa.RecordBatch:
            rows = [(c, m, part % GROUPS, np.asarray(s, float).ravel()) for (c, m), s in states.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.float64()))], ["carrier_id", "metric", "part", "state"])

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            ids = b.schema.field(0).type
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            which, levels = coded.indices.to_numpy(zero_copy_only=False), np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7)])
            order = np.argsort(which, kind="stable")
            ends = np.flatnonzero(np.diff(which[order])) + 1
            for rows in np.split(order, ends):
                carrier = coded.dictionary[int(which[rows[0]])].as_py()
                for name, m in metrics.items():
                    s = states.get((carrier, name))
                    states[carrier, name] = m.update(m.init() if s is None else s, levels[rows, :3], levels[rows, 3:])
            if len(states) > HELD:
                yield flushed()
                states = {}
        if states:
            yield flushed()

    def merged(part: pa.Table) -> np.ndarray:
        m = metrics[part["metric"][0].as_py()]
        whole = None
        for s in part["state"].to_numpy():
            s = np.array(s, float).reshape(np.shape(m.init()))
            whole = s if whole is None else m.merge(whole, s)
        return whole

    def some(part: pa.Table) -> pa.Table:
        return part.slice(0, 1).set_column(3, "state", pa.array([np.asarray(merged(part), float).ravel()], pa.list_(pa.float64())))

    def last(part: pa.Table) -> pa.Table:
        m = metrics[part["metric"][0].as_py()]
        return pa.table([part["carrier_id"].slice(0, 1), part["metric"].slice(0, 1), pa.array([float(m.finish(merged(part)))])], ["carrier_id", "metric", "value"])

    states = both.mapInArrow(run, schema).groupBy("carrier_id", "metric", "part").applyInArrow(some, schema)
    return states.groupBy("carrier_id", "metric").applyInArrow(last, f"carrier_id {kind}, metric string, value double")
