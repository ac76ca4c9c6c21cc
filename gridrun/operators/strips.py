"""Row strips of a raster: the unit in which layers are burned and laid over each other.

A strip holds ``STRIP`` rows, so a group is bounded by the raster's width whatever the raster holds. Boxes cross the
shuffle as boxes and become runs in their strip only. Inside a strip a pixel's place is one number, ``row * span + col``
with ``span`` beyond the last column, so that all rows are swept at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = 512


def _starts(t: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each group of equal keys; null is a key of its own."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in keys:
        v, known = np.asarray(pc.fill_null(t.column(c), 0)), np.asarray(pc.is_valid(t.column(c)))
        new[1:] |= (v[1:] != v[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches -> tables of whole groups; a group is put together once, however many batches it fills."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(c)[a.num_rows - 1].as_py() == b.column(c)[0].as_py() for c in keys)

    for b in batches:
        if not b.num_rows:
            continue
        last = int(_starts(b, keys)[-1])
        if last == 0 and held and same(held[-1], b):
            held.append(b)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, b.slice(0, last)] if last else held).combine_chunks()
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Work of the groups that go into one call, as weighed by ``grouped``.
WEIGHT_AT_ONCE = 1_000_000


def _portions(t: pa.Table, keys: list[str], weigh: Callable[[pa.Table], np.ndarray] | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The table cut between groups, so that no part but a single group weighs much more than ``WEIGHT_AT_ONCE``."""
    starts = _starts(t, keys)
    if weigh is None:
        yield t, starts
        return
    end = np.append(starts[1:], t.num_rows)
    portion = np.cumsum(np.add.reduceat(weigh(t), starts)) // WEIGHT_AT_ONCE
    cut = np.flatnonzero(np.append(True, portion[1:] != portion[:-1]))
    for a, z in zip(cut, np.append(cut[1:], len(starts)), strict=True):
        yield t.slice(starts[a], end[z - 1] - starts[a]), starts[a:z] - starts[a]


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
            weigh: Callable[[pa.Table], np.ndarray] | None = None) -> DataFrame:
    """``fn(table, starts)`` over whole groups of equal integer keys, many small ones in one call.

    ``starts`` holds the first row of each group. A table holds about one Arrow batch, or one group if that is larger,
    so memory is bounded as by a call per group, and very many small groups cost no call each. ``weigh`` gives the
    work of each row, where rows become much larger than they are.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys):
            for part, starts in _portions(t, keys, weigh):
                yield from fn(part, starts).to_batches()

    # Boxes are small for what is made of them, so their partitions must not be put together by size.
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


def numbers(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the group of each of ``n`` rows."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def in_strips(boxes: DataFrame, strip: int = STRIP) -> DataFrame:
    """Boxes of rows ``r0`` to ``r1`` cut at strips of rows, with their ``strip``."""
    s = boxes.withColumn("strip", F.explode(F.sequence(F.floor(F.col("r0") / strip), F.floor(F.col("r1") / strip))))
    return s.withColumn("r0", F.greatest("r0", F.col("strip") * strip).cast("int")).withColumn(
        "r1", F.least("r1", F.col("strip") * strip + strip - 1).cast("int"))


def _lines(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes -> one run per row: index of the box, row, first and last column."""
    r0, r1 = t.column("r0").to_numpy().astype(np.int64), t.column("r1").to_numpy().astype(np.int64)
    n = r1 - r0 + 1
    i = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + r0[i]
    return i, row, t.column("c0").to_numpy().astype(np.int64)[i], t.column("c1").to_numpy().astype(np.int64)[i]


def _lowest(start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping stretches ``[start, end)`` -> stretches of the lowest code over each place."""
    if not len(code):
        return start, end, code
    bits = int(code.max()).bit_length() + 1
    ends = np.sort(np.concatenate([(start << bits) | (code << 1), (end << bits) | (code << 1) | 1]))  # place, code, whether it ends
    at, k, d = ends >> bits, (ends >> 1) & ((1 << bits - 1) - 1), 1 - 2 * (ends & 1)
    top = np.full(len(at), -1)
    for c in range(int(code.max()), -1, -1):
        top[np.cumsum(np.where(k == c, d, 0)) > 0] = c
    last = np.append(at[1:] != at[:-1], True)
    at, top = at[last], top[last]
    return at[:-1][top[:-1] >= 0], at[1:][top[:-1] >= 0], top[:-1][top[:-1] >= 0]


def _coded(values: pa.ChunkedArray, ordered: bool) -> tuple[np.ndarray, pa.Array]:
    """Values as codes, -1 for null; with ``ordered`` the codes are in the order of the values."""
    d = pa.chunked_array([values.combine_chunks()]).dictionary_encode().combine_chunks()
    code, known = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
    if ordered and len(known):
        order = known.to_numpy(zero_copy_only=False).argsort()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code, known = np.where(code >= 0, rank[code], -1), known.take(pa.array(order))
    return code, known


def lines_of(t: pa.Table) -> np.ndarray:
    """Rows of each box, as the weight of ``grouped``."""
    return t.column("r1").to_numpy().astype(np.int64) - t.column("r0").to_numpy() + 1


def laid_over(names: list[str], burned: tuple[str, ...], strip: int, t: pa.Table, starts: np.ndarray, under: str | None = None) -> tuple[np.ndarray, dict]:
    """The layers of some strips as segments on which each layer is constant: group of each segment, and its columns; see ``lay_over``."""
    box, row, c0, c1 = _lines(t)
    span = (int(c1.max()) if len(c1) else 0) + 2
    base = int(c0.min()) if len(c0) else 0
    top = t.column("strip").to_numpy().astype(np.int64)[starts] * strip
    group = numbers(starts, t.num_rows)[box]
    line = group * strip + row - top[group]
    if under is not None:
        met = np.zeros(len(starts) * strip, bool)
        met[line[t.column("layer").to_numpy()[box] == names.index(under)]] = True
        met = met[line]
        box, line, c0, c1 = box[met], line[met], c0[met], c1[met]
    start, end = line * (span - base) + c0 - base, line * (span - base) + c1 + 1 - base
    layer = t.column("layer").to_numpy()[box]
    stretches, known = [], []
    for i, name in enumerate(names):
        mine = np.flatnonzero(layer == i)
        code, values = _coded(t.column(f"v_{name}"), name in burned)
        a, z, k = start[mine], end[mine], code[box[mine]]
        if name in burned:
            a, z, k = _lowest(a[k >= 0], z[k >= 0], k[k >= 0])
        else:
            order = np.argsort(a, kind="stable")
            a, z, k = a[order], z[order], k[order]
        stretches.append((a, z, k))
        known.append(values)
    at = np.sort(np.concatenate([x for a, z, _ in stretches for x in (a, z)]))
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    state = np.full((len(names), len(at)), -1)
    for s, (a, z, k) in zip(state, stretches, strict=True):
        if len(a):
            i = np.searchsorted(a, at, "right") - 1
            s[:] = np.where((i >= 0) & (at < z[i]), k[i], -1)
    new = np.append(True, (state[:, 1:] != state[:, :-1]).any(axis=0)) if len(at) else np.zeros(0, bool)
    at, state = at[new], state[:, new]
    on = (state[:, :-1] >= 0).any(axis=0) if under is None else state[names.index(under), :-1] >= 0
    a, z, state = at[:-1][on], at[1:][on], state[:, :-1][:, on]
    line, first = np.divmod(a, span - base)
    group, row = np.divmod(line, strip)
    out = {"raster_id": t.column("raster_id").take(pa.array(starts[group])), "row": pa.array((row + top[group]).astype(np.int32)),
           "c0": pa.array((first + base).astype(np.int32)), "c1": pa.array((first + base + z - a - 1).astype(np.int32))}
    for name, s, values in zip(names, state, known, strict=True):
        out[name] = values.take(pa.array(s, mask=s < 0))
    return group, out


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches ``[start, end)`` -> maximal stretches; those that overlap or touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > far[:-1]))
    return start[first], far[np.append(first[1:], len(far)) - 1]


#: Stretches put together at once when a kernel is spread.
AT_ONCE = 4_000_000


def _grown(start: np.ndarray, end: np.ndarray, kernel: list[tuple[int, int]], span: int) -> tuple[np.ndarray, np.ndarray]:
    """A kernel put on every place of ``[start, end)``; rows are ``span`` places, of which the last two are outside the frame."""
    start, end = _union(start, end)
    if not len(start):
        return start, end

    def widened(hw: int) -> tuple[np.ndarray, np.ndarray]:
        row = start // span * span
        return np.maximum(start - hw, row), np.minimum(end + hw, row + span - 2)

    if len(kernel) > 16 and len({hw for _, hw in kernel}) == 1:      # one width: doubled row by row
        a, z = widened(kernel[0][1])
        a, z = _union(a + kernel[0][0] * span, z + kernel[0][0] * span)
        done = 1
        while done < len(kernel):
            step = min(done, len(kernel) - done)
            a, z = _union(np.concatenate([a, a + step * span]), np.concatenate([z, z + step * span]))
            done += step
        return a, z
    many = max(1, AT_ONCE // len(start))
    a, z = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(kernel), many):
        parts = [(dy * span, *widened(hw)) for dy, hw in kernel[at : at + many]]
        a, z = _union(np.concatenate([a, *(x + d for d, x, _ in parts)]), np.concatenate([z, *(y + d for d, _, y in parts)]))
    return a, z


def _gaps(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``[start, end)``, in maximal stretches, leaves free of the frame in the lines ``first`` to ``last`` of each group."""
    n = last - first + 2
    edge = (np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)) * span
    left, right = edge - 2, edge.copy()                           # the two places between lines are taken as well
    right[np.cumsum(n)[:-1] - 1] = first[1:] * span               # and so is all between two groups
    start, end = _union(np.concatenate([start, left]), np.concatenate([end, right]))
    return end[:-1], start[1:]


def spread(runs: DataFrame, kernel: list[tuple[int, int]], strip: int = STRIP, erode: bool = False) -> DataFrame:
    """Runs ``(raster_id, row, c0, c1, width, height)`` dilated by a kernel of ``(dy, half_width)``, or eroded, as maximal runs.

    A run crosses the shuffle once per strip that it reaches, not once per kernel row. To erode, what the runs leave free
    of the frame is dilated by the kernel turned round, and the rest stays.
    """
    kernel = sorted((-dy, hw) for dy, hw in kernel) if erode else sorted(kernel)
    lo, hi = kernel[0][0], kernel[-1][0]
    top, bottom = F.greatest(F.col("row") + lo, F.lit(0)), F.least(F.col("row") + hi, F.col("height") - 1)
    cut = runs.select("raster_id", "row", "c0", "c1", "width", "height").filter((top <= bottom) & (F.col("c0") <= F.col("c1"))).withColumn(
        "strip", F.explode(F.sequence(F.floor(top / strip), F.floor(bottom / strip))))
    id_type, row_type = (runs.schema[c].dataType.simpleString() for c in ("raster_id", "row"))
    row_arrow = pa.int64() if row_type == "bigint" else pa.int32()

    pad = max(hi, 0) - min(lo, 0) + 1                             # lines that no kernel row leaves, above and below a strip

    def sized(row: np.ndarray, c0: np.ndarray, c1: np.ndarray, group: np.ndarray, first: np.ndarray, w: int, h: int) -> tuple[np.ndarray, ...]:
        """Groups of rasters of one size: group, row, first and last column."""
        span, block = w + 2, strip + 2 * pad
        at = np.arange(len(first)) * block + pad                  # line of each group's first row
        last = np.minimum(first + strip, h) - 1
        c0, c1 = np.maximum(c0, 0), np.minimum(c1, w - 1)
        ok = (c0 <= c1) & ((row >= 0) & (row < h) if erode else True)
        line = (at[group] + row - first[group])[ok] * span
        a, z = line + c0[ok], line + c1[ok] + 1
        if erode:
            a, z = _grown(*_gaps(a, z, at + np.maximum(first - hi, 0) - first, at + np.minimum(last - lo, h - 1) - first, span), kernel, span)
            inside = _inside(a, at, last - first, block, span)
            a, z = _gaps(a[inside], z[inside], at, at + last - first, span)
        else:
            a, z = _grown(a, z, kernel, span)
        keep = _inside(a, at, last - first, block, span) & (a < z)
        a, z = a[keep], z[keep]
        line, left = np.divmod(a, span)
        g = line // block
        return g, line - at[g] + first[g], left, left + z - a - 1

    def grown(t: pa.Table, starts: np.ndarray) -> pa.Table:
        row, c0, c1, width, height, at = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "c0", "c1", "width", "height", "strip"))
        group = numbers(starts, t.num_rows)
        size = np.stack([np.maximum.reduceat(width, starts), np.maximum.reduceat(height, starts)])
        out = []
        for w, h in np.unique(size, axis=1).T.tolist():
            mine = np.flatnonzero((size[0] == w) & (size[1] == h))
            some = np.isin(group, mine)
            g, *found = sized(row[some], c0[some], c1[some], np.searchsorted(mine, group[some]), at[starts[mine]] * strip, w, h)
            out.append((mine[g], *found))
        g, rows, left, right = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"raster_id": t.column("raster_id").take(pa.array(starts[g])), "row": pa.array(rows).cast(row_arrow),
                         "c0": pa.array(left.astype(np.int32)), "c1": pa.array(right.astype(np.int32))})

    return grouped(cut, ["raster_id", "strip"], grown, f"raster_id {id_type}, row {'bigint' if row_type == 'bigint' else 'int'}, c0 int, c1 int")


def _inside(place: np.ndarray, at: np.ndarray, rows: np.ndarray, block: int, span: int) -> np.ndarray:
    """Whether a place lies in the first ``rows + 1`` lines from ``at`` of its group."""
    line = place // span
    g = np.clip(line // block, 0, len(at) - 1)
    return (line >= at[g]) & (line <= at[g] + rows[g])


def box_layer_of(layer: DataFrame, value=None) -> DataFrame:
    """Runs ``(raster_id, row, c0, c1)``, or boxes of rows ``r0`` to ``r1``, as a layer of ``lay_over``; without ``value`` a mere presence."""
    r0, r1 = ("r0", "r1") if "r0" in layer.columns else ("row", "row")
    return layer.select("raster_id", F.col(r0).alias("r0"), F.col(r1).alias("r1"), "c0", "c1", (F.lit(1) if value is None else F.col(value)).alias("value"))


def lay_over(layers: dict[str, DataFrame], burned: tuple[str, ...] = (), strip: int = STRIP, under: str | None = None) -> DataFrame:
    """Boxes ``(raster_id, r0, r1, c0, c1, value)`` of each layer -> segments ``(raster_id, row, c0, c1, <layer>...)``.

    Segments are maximal and have a value of some layer; a layer without one there gives null. Boxes of a layer named in
    ``burned`` may overlap, and the lowest value wins; other layers have no overlaps but of equal boxes. With ``under``
    only segments with a value of that layer are made.
    """
    every, id_type, kind = boxes_of(layers, strip)
    names = list(layers)

    def laid(t: pa.Table, starts: np.ndarray) -> pa.Table:
        return pa.table(laid_over(names, burned, strip, t, starts, under)[1])

    return grouped(every, ["raster_id", "strip"], laid, f"raster_id {id_type}, row int, c0 int, c1 int, " + ", ".join(f"`{n}` {kind[n]}" for n in names), lines_of)


def boxes_of(layers: dict[str, DataFrame], strip: int) -> tuple[DataFrame, str, dict[str, str]]:
    """Boxes of all layers cut at strips, the type of ``raster_id`` and those of the values."""
    parts = [in_strips(d.select("raster_id", "r0", "r1", "c0", "c1", "value"), strip).withColumn("layer", F.lit(i)).withColumnRenamed("value", f"v_{n}")
             for i, (n, d) in enumerate(layers.items())]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every, every.schema["raster_id"].dataType.simpleString(), {n: d.schema["value"].dataType.simpleString() for n, d in layers.items()}
