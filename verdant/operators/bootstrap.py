"""Bootstrap intervals by Poisson weights, from one pass over the items.

Resampling n items with replacement and counting is, for many items, a Poisson(1) count for each item. The count
of (item, replicate) comes from an integer hash by inverse distribution, so any engine makes the same ones, in any
order, and no item meets another. A task keeps one row of sums a replicate and cell; items are never copied once
for each replicate, and there may be any number of them and of outcomes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.operators.tasks import tasks_for

REPLICATES, SEED, BLOCK, FEW, SUPPORTED_FROM = 5000, 42, 512, 16, 20
HELD, KNOWN, LONG = 1 << 21, 1 << 16, 32  # rows and kinds of rows that a task holds at once; rows of an item that is compared with others
PRIME = (1 << 31) - 1  # of the mixing


def poisson_steps() -> list[int]:
    """Of u in 0..PRIME - 1, where the weight becomes 1, 2, 3, ...: the distribution of Poisson(1)."""
    out, term, total, k = [], math.exp(-1), 0.0, 0
    while (step := round((total := total + term) * PRIME)) < PRIME:
        out.append(step)
        k += 1
        term /= k
    return out


def replicate_factors(replicates: int, seed: int) -> np.ndarray:
    return np.array([1 + int(hashlib.md5(f"replicate {r}:{seed}".encode()).hexdigest()[:8], 16) % (PRIME - 1) for r in range(replicates)], np.int64)


def item_factor(item: Column, seed: int) -> Column:
    first = F.substring(F.md5(F.concat(item.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8)
    return 1 + F.conv(first, 16, 10).cast("long") % (PRIME - 1)


def _item_factors(items: pa.Array, seed: int) -> np.ndarray:
    """The same, of texts as bytes: once for an item of a batch, not for each of its rows."""
    own, end = items.dictionary_encode(), f":{seed}".encode()
    each = (int.from_bytes(hashlib.md5(i + end).digest()[:4]) for i in own.dictionary.to_pylist())
    return np.fromiter((1 + f % (PRIME - 1) for f in each), np.int64, len(own.dictionary))[own.indices.to_numpy()]


#: A draw is s = a * c modulo PRIME, a and c the squares of both factors; its weight is the number of steps up to s + _ADD,
#: modulo PRIME. h, the upper 32 of 64 bits of a * ceil(c * 2^64 / PRIME), is s * 2^32 / PRIME, less than 1/2 above it
#: before rounding down. The latter grows by over 2 from one s to the next, so comparing h is comparing s, exactly.
_ADD, _DENSE, _WIDTH = 12345, 5, 8192
_UPPER = [np.uint32(((s - _ADD) << 32) // PRIME) for s in [*poisson_steps(), PRIME]]  # at the last, s + _ADD wraps and the weight is 0
_RARE = [int(h) for h in _UPPER[_DENSE:]]


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x % PRIME).astype(np.uint64)


class _Draws:
    """Weights of FEW items at a time for a slice of the replicates, thousands wide: numpy copies shorter operands to its buffers first."""

    def __init__(self, factors: np.ndarray):
        c = _squares(factors)
        parts = max(1, -(-len(c) // _WIDTH))
        self.width = -(-len(c) // parts)
        c = np.pad(c, (0, parts * self.width - len(c)))
        self.slices = [(i, min(i + self.width, len(factors))) for i in range(0, len(c), self.width)] if len(c) else []
        self.c = c * (4 * PRIME + 8) + (4 * c + PRIME - 1) // PRIME  # ceil(c * 2^64 / PRIME), as 2^64 = 4 * PRIME^2 + 8 * PRIME + 4
        self.x, self.h, self.over, self.w = (np.empty((FEW, self.width), t) for t in (np.uint64, np.uint32, bool, np.uint8))
        self.all_h, self.all_w = memoryview(self.h.reshape(-1)), memoryview(self.w.reshape(-1))

    def of(self, a: np.ndarray, start: int) -> np.ndarray:
        """Weights of at most FEW items, by their squares, in the slice from start; valid until the next call."""
        n = len(a)
        x, h, over, w = self.x[:n], self.h[:n], self.over[:n], self.w[:n]
        np.multiply(a[:, None], self.c[start : start + self.width], out=x)
        np.copyto(h, x.view(np.uint32)[:, sys.byteorder == "little" :: 2])
        np.greater_equal(h, _UPPER[0], out=w.view(bool))
        for step in _UPPER[1:_DENSE]:
            np.greater_equal(h, step, out=over)
            np.add(w, over.view(np.uint8), out=w)
        np.greater_equal(h, _UPPER[_DENSE], out=over)
        rare, j = over.tobytes(), -1  # one in two thousand: bytes are searched faster than arrays
        while (j := rare.find(1, j + 1)) >= 0:
            k = bisect.bisect_right(_RARE, self.all_h[j])
            self.all_w[j] = 0 if k == len(_RARE) else _DENSE + k
        return w


def weights(items: np.ndarray, factors: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Counts (item x replicate): u = m * m + 12345 for m = item * factor, modulo PRIME, against the steps. out: takes them, if given."""
    out = np.empty((len(items), len(factors)), np.uint8) if out is None else out
    a, draws = _squares(items), _Draws(factors)
    for i in range(0, len(a), FEW):
        for start, end in draws.slices:
            out[i : i + FEW, start:end] = draws.of(a[i : i + FEW], start)[:, : end - start]
    return out


def weights_sql(items: str, item: str, replicates: int = REPLICATES, seed: int = SEED) -> str:
    """The same as SQL of other engines: item, r, w for the rows of a query with distinct items; weights of 0 left out."""
    steps = " + ".join(f"(u >= {t})::TINYINT" for t in poisson_steps())
    factor = lambda x: f"1 + ('0x' || substr(md5({x} || ':{seed}'), 1, 8))::BIGINT % {PRIME - 1}"
    return f"""SELECT {item}, r, ({steps})::DOUBLE AS w FROM (SELECT {item}, r, (m * m + 12345) % {PRIME} AS u FROM (SELECT {item}, r, (a * c) % {PRIME} AS m
FROM (SELECT {item}, {factor(f"{item}::VARCHAR")} AS a FROM ({items})), (SELECT r, {factor("'replicate ' || r")} AS c FROM range({replicates}) t(r)))) WHERE u >= {poisson_steps()[0]}"""


def _places(batch: pa.RecordBatch, cell: list[str], places: dict[tuple, int]) -> np.ndarray:
    """The place of each row's cell; new cells get the next ones."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in cell:
        own = batch[c].dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    _, row, code = np.unique(code, return_index=True, return_inverse=True)
    return np.array([places.setdefault(tuple(batch[c][i].as_py() for c in cell), len(places)) for i in row.tolist()], np.int64)[code]


def _alike(first: np.ndarray, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A number for each item, the same only where the codes of its rows are. first: each item's first row; rows: how many it has."""
    out, base, used = np.empty(len(first), np.int64), int(code.max(initial=0)) + 1, 0
    for n in np.unique(rows).tolist():
        own = np.flatnonzero(rows == n)
        if n > LONG:  # alike only to itself
            p = np.arange(len(own))
        else:
            p, bound = np.zeros(len(own), np.int64), 1
            for j in range(n):
                if bound * base >= 1 << 62:
                    p, bound = np.unique(p, return_inverse=True)[1], len(own)
                p, bound = p * base + code[first[own] + j], bound * base
            p = np.unique(p, return_inverse=True)[1]
        out[own] = p + used
        used += int(p.max()) + 1
    return out


class _Totals:
    """Sums over the items as often as drawn: one row a value of a place, one column a replicate."""

    def __init__(self, factors: np.ndarray, k: int):
        self.factors, self.draws, self.k, self.total = factors, _Draws(factors), k, np.zeros((0, len(factors)))

    def add(self, key: np.ndarray, place: np.ndarray, values: np.ndarray, places: int) -> None:
        """key: the item's factor and the row's code, 32 bits each. place, values: of each code.

        Items whose rows have the same codes are alike: their weights are added before they are multiplied by values.
        """
        self.total = np.pad(self.total, ((0, places * self.k - len(self.total)), (0, 0)))
        key.sort()
        factor, code = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, factor[1:] != factor[:-1]])
        rows = np.diff(first, append=len(key))
        like = _alike(first, rows, code)
        order = np.argsort(like, kind="stable")
        first, rows, like = first[order], rows[order], like[order]
        a = _squares(factor[first])
        # runs of alike items within FEW that are drawn together
        run = np.flatnonzero(np.r_[True, like[1:] != like[:-1]] | (np.arange(len(like)) % FEW == 0))
        at = 0
        while at < len(run):
            end = min(at + BLOCK, len(run))
            while end < len(run) and run[end] % FEW:
                end -= 1
            self._block(a, run[at:end], int(run[end]) if end < len(run) else len(a), first, rows, code, place, values, places)
            at = end

    def _block(self, a, run, end, first, rows, code, place, values, places) -> None:
        n, k, lengths = len(run), self.k, rows[run]
        row = np.repeat(first[run] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        own = code[row]
        where = place[own] * n + np.repeat(np.arange(n), lengths)
        wide = np.stack([np.bincount(where, values[own, j], places * n) for j in range(k)]).reshape(k, places, n).swapaxes(0, 1).reshape(-1, n)
        some = wide.any(axis=1)
        wide = wide[some]
        # whole numbers whose sums single precision holds
        small = 255 * np.abs(wide).sum(axis=1).max(initial=0) < 1 << 24 and bool((wide == np.rint(wide)).all())
        drawn = np.empty((n, len(self.factors)), np.uint8)
        ends, i = np.r_[run[1:], end].tolist(), 0
        starts = run.tolist()
        while i < n:
            tile, j = starts[i], i
            while j < n and starts[j] < tile + FEW:
                j += 1
            for s, e in self.draws.slices:
                w = self.draws.of(a[tile : ends[j - 1]], s)
                for r in range(i, j):
                    np.add.reduce(w[starts[r] - tile : ends[r] - tile, : e - s], axis=0, dtype=np.uint8, out=drawn[r, s:e])
            i = j
        self.total[some] += (w := wide.astype(np.float32 if small else np.float64)) @ drawn.astype(w.dtype)


def _sums(cell: list[str], names: list[str], table: np.ndarray | None, factors: np.ndarray, seed: int, types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row's values are those of its code in the table, or without one its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, places, totals, keys, held, known = len(names), {}, _Totals(factors, len(names)), [], 0, {}

        def add() -> None:
            nonlocal held
            if table is None:
                place, values = np.array([c[0] for c in known], np.int64), np.array([c[1:] for c in known], np.float64).reshape(-1, k)
            else:
                place, values = np.repeat(np.arange(len(places)), len(table)), np.tile(table, (len(places), 1))
            key = np.concatenate(keys)
            keys.clear()
            totals.add(key, place, values, len(places))
            known.clear()
            held = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            code = _places(batch, cell, places)
            if table is None:
                x, at = [batch[v].to_numpy(zero_copy_only=False) for v in names], code
                for v in x:
                    own, i = np.unique(v, return_inverse=True)
                    code = np.unique(code * len(own) + i, return_inverse=True)[1]
                _, row, code = np.unique(code, return_index=True, return_inverse=True)
                code = np.array([known.setdefault(c, len(known)) for c in zip(at[row].tolist(), *(v[row].tolist() for v in x))], np.int64)[code]
            else:
                code = code * len(table) + batch["_code"].to_numpy()
            keys.append(_item_factors(batch["_item"], seed) << 32 | code)
            held += batch.num_rows
            if held >= HELD or len(known) >= KNOWN:
                add()
        if held:
            add()
        for key, i in places.items():
            own = [pa.array([v] * len(factors), t) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(factors))), *(pa.array(totals.total[i * k + j]) for j in range(k))], [*cell, "replicate", *names])

    return run


def _replicate_sums(rows: DataFrame, item: str, cell: list[str], columns: dict[str, Column], names: list[str], table: np.ndarray | None, replicates: int, seed: int) -> DataFrame:
    own = rows.filter(F.col(item).isNotNull()).select(F.col(item).alias("_item"), *cell, *(v.alias(k) for k, v in columns.items()))
    # the work is in the draws: as many tasks as partitions, however few bytes these are
    own = own.repartition(tasks_for(rows), "_item").select(F.col("_item").cast("string").cast("binary").alias("_item"), *cell, *columns)
    types = rows.select(*cell).limit(0).toArrow().schema.types if cell else []
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cell), "replicate long", *(f"`{v}` double" for v in names)])
    part = own.mapInArrow(_sums(cell, names, table, replicate_factors(replicates, seed), seed, types), schema)
    return part.groupBy(*cell, "replicate").agg(*(F.sum(v).alias(v) for v in names))


def replicate_sums(rows: DataFrame, item: str, cell: list[str], values: dict[str, Column], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """cell, replicate, and the sum of each value over the items as often as the replicate draws them.

    An item has the same weight in all cells (B1, B3-B5), so that cells can be compared; where it has no row, or a
    null value, it adds nothing. An item's rows need not meet: that they do only spares draws.
    """
    columns = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}
    return _replicate_sums(rows, item, cell, columns, list(values), None, replicates, seed)


def replicate_counts(rows: DataFrame, item: str, cell: list[str], code: Column, values: dict[str, list[float]], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The same for rows of few kinds: code is the kind's number, from 0 and never null, and each value has a list by it."""
    table = np.array(list(values.values()), np.float64).T
    return _replicate_sums(rows, item, cell, {"_code": code.cast("int")}, list(values), table, replicates, seed)


def _place_in(x: Column, of: list[str]) -> Column:
    """The place of x in a list of distinct values, or their number."""
    out = F.lit(len(of))
    for i, v in reversed(list(enumerate(of))):
        out = F.when(x == v, i).otherwise(out)
    return out


def intervals(sums: DataFrame, cell: list[str], metrics: dict[str, Column], replicates: int = REPLICATES, level: float = 0.95, upper_exclusive: bool = True) -> DataFrame:
    """cell, metric, lo, hi by sorted index (W11); upper_exclusive: the index before int(R (1 + level) / 2), as published for all but B1."""
    lo, hi = int(round((1 - level) / 2 * replicates, 9)), int(round((1 + level) / 2 * replicates, 9)) - (1 if upper_exclusive else 0)
    each = sums.select(*cell, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()))).alias("m")).select(*cell, "m.*")
    own = each.groupBy(*cell, "metric").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a value for each replicate
    return own.select(*cell, "metric", F.element_at("v", lo + 1).alias("lo"), F.element_at("v", min(hi, replicates - 1) + 1).alias("hi"))


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def accuracy_intervals(rows: DataFrame, item: str, cell: list[str], ok: Column, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Each cell's accuracy a, and 2a / (1 + a)."""
    sums = replicate_counts(rows, item, cell, F.when(ok, 1).otherwise(0), {"_ok": [0, 1], "_n": [1, 1]}, replicates, seed)
    a = _over(F.col("_ok"), F.col("_n"))
    return intervals(sums, cell, {"accuracy": a, "f1": 2 * a / (1 + a)}, replicates)


def f1_intervals(rows: DataFrame, item: str, cell: list[str], truth: Column, seen: Column, classes: list[str], supported: list[str] = (), replicates: int = REPLICATES, seed: int = SEED, upper_exclusive: bool = False) -> DataFrame:
    """F1 of each of the classes, 0 for absent ones, and its mean over them and over the supported ones (B1).

    The lists are fixed beforehand, so a class that is only predicted, or missing from a draw, counts.
    """
    own, values = list(dict.fromkeys(classes)), {}
    pairs = [(t, s) for t in [*own, None] for s in [*own, None]]
    for i, c in enumerate(classes):
        values |= {f"_b{i}": [2 * (t == c and s == c) for t, s in pairs], f"_a{i}": [(t == c) + (s == c) for t, s in pairs]}
    sums = replicate_counts(rows, item, cell, _place_in(truth, own) * (len(own) + 1) + _place_in(seen, own), values, replicates, seed)
    f1 = {c: _over(F.col(f"_b{i}"), F.col(f"_a{i}")) for i, c in enumerate(classes)}
    mean = lambda own: sum((f1[c] for c in own), F.lit(0.0)) / len(own)
    metrics = {f"f1_{c}": v for c, v in f1.items()} | {"macro_f1": mean(classes)} | ({"macro_f1_supported": mean(supported)} if supported else {})
    return intervals(sums, cell, metrics, replicates, upper_exclusive=upper_exclusive)


def cell_intervals(rows: DataFrame, item: str, cell: list[str], truth: Column, seen: Column, classes: list[str], replicates: int = REPLICATES, seed: int = SEED, supported_from: int = SUPPORTED_FROM) -> DataFrame:
    """The same by cells with the published upper index, and each class's support, low below a bound (B2)."""
    out = f1_intervals(rows, item, cell, truth, seen, classes, (), replicates, seed, upper_exclusive=True)
    n = rows.groupBy(*cell).agg(*(F.count_if(truth == c).alias(f"f1_{c}") for c in classes), F.count("*").alias("macro_f1"))
    support = n.select(*cell, F.explode(F.create_map(*(x for k in [*(f"f1_{c}" for c in classes), "macro_f1"] for x in (F.lit(k), F.col(f"`{k}`"))))).alias("metric", "support"))
    return out.join(support, [*cell, "metric"]).withColumn("low_support", F.col("support") < supported_from)


def share_intervals(rows: DataFrame, item: str, cell: list[str], outcome: Column, categories: list[str], right: str = "Correct", replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Accuracy, and each category's share of the wrong answers, 0 where none is (B4). The categories are fixed beforehand."""
    own = list(dict.fromkeys([right, *categories]))
    kinds = {"_ok": right} | {f"_k{i}": c for i, c in enumerate(categories)}
    values = {"_n": [1] * (len(own) + 1)} | {k: [int(o == c) for o in [*own, None]] for k, c in kinds.items()}
    sums = replicate_counts(rows, item, cell, _place_in(outcome, own), values, replicates, seed)
    wrong = F.col("_n") - F.col("_ok")
    return intervals(sums, cell, {"accuracy": _over(F.col("_ok"), F.col("_n"))} | {f"share_{c}": _over(F.col(f"_k{i}"), wrong) for i, c in enumerate(categories)}, replicates)


def mean_intervals(items: DataFrame, item: str, mean: Column, replicates: int = REPLICATES, seed: int = SEED, upper_exclusive: bool = False) -> DataFrame:
    """The mean of the items' own means (B5). An item without a mean is not drawn."""
    sums = replicate_sums(items.filter(mean.isNotNull()), item, [], {"_v": mean, "_n": F.lit(1)}, replicates, seed)
    return intervals(sums, [], {"mean": _over(F.col("_v"), F.col("_n"))}, replicates, upper_exclusive=upper_exclusive)


def dense_positions(items: DataFrame, item: str, width: int = 10_000) -> DataFrame:
    """item, pos: 0, 1, 2 in order of whole-number items, numbered within ranges of `width` values and added up over the ranges."""
    own = items.select(item).distinct().withColumn("_range", F.floor(F.col(item) / width))
    before = own.groupBy("_range").agg(F.count("*").alias("_k"))
    before = before.select("_range", (F.sum("_k").over(W.orderBy("_range")) - F.col("_k")).alias("_before"))  # a row for each range
    turn = F.row_number().over(W.partitionBy("_range").orderBy(item))
    return own.withColumn("_turn", turn).join(before, "_range").select(item, (F.col("_before") + F.col("_turn") - 1).alias("pos"))


def resampled(rows: DataFrame, item: str, cell: list[str], ok: str, draws: int, modulus: int = 2147483647) -> DataFrame:
    """lo, hi of each cell's accuracy over draws that integer mixing makes, so that any engine gets the same.

    Draw r takes, for j from 0 to n - 1, the item at position mix(r * 1000003 + j * 7919 + 17) % n.
    """
    places = dense_positions(rows, item)
    n = places.agg(F.count("*").alias("_n"))
    each = places.select("pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r")).crossJoin(F.broadcast(n))  # one row
    mixed = F.expr(f"aggregate(array(1, 2, 3), cast((r * 1000003 + pos * 7919 + 17) % {modulus} as bigint), (m, i) -> (m * m + 12345) % {modulus}) % _n")
    times = each.select("r", mixed.alias("pos")).groupBy("r", "pos").agg(F.count("*").alias("times"))
    wide = rows.groupBy(item).agg(F.collect_list(F.struct(*cell, F.col(ok).cast("int").alias("ok"))).alias("cells")).join(places, item).select("pos", "cells")
    drawn = times.join(wide, "pos").select("r", "times", F.explode("cells").alias("c")).select("r", "times", "c.*")
    rates = drawn.groupBy(*cell, "r").agg((F.sum(F.col("times") * F.col("ok")) / F.sum("times")).alias("v"))
    lo, hi = int(round(0.025 * draws, 9)), int(round(0.975 * draws, 9)) - 1
    own = rates.groupBy(*cell).agg(F.sort_array(F.collect_list("v")).alias("v"))
    return own.select(*cell, F.element_at("v", lo + 1).alias("lo"), F.element_at("v", hi + 1).alias("hi"))
