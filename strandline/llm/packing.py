"""Filling of fixed-capacity containers with documents, measured in tokens.

A grouping genetic algorithm: a solution is a set of containers, and crossover hands on whole, well-filled containers. Those of
one parent are injected into the other, containers that would hold an item twice are dissolved, and the items displaced first
change places with one or two items of a container that they fill better, then go to where they fit best, largest first. All
solutions start as a best fit in random order; no sorted packing is among them until the last epoch, where one joins so that
the result is never worse than it.

Items are spread by a hash over shards of bounded size. Each shard evolves on several islands, spread over the tasks. Between
two epochs every island of a shard that is not yet optimal (it needs more containers than its tokens demand) receives the elite
of its neighbour; of the others, only the labels of the solution are kept. The loosest containers of all shards are emptied and
packed once more, together.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written

#: Items of a shard, about.
SHARD = 2048
ISLANDS = 3
POPULATION = 4
#: Generations of an epoch; the first few are always run.
GENERATIONS, ALWAYS = 16, 2
EPOCHS = 3
#: Islands of a task at least, and tasks at most: of more islands, each task takes more.
A_TASK, TASKS = 4, 100_000
#: Of each shard, so many containers are emptied and packed again across shards, the loosest, if filled less than this.
LOOSEST, LOOSE = 4, 0.97
#: Most containers that a crossover injects, and most displaced items whose pairs are tried for an exchange.
INJECTED, PAIRED = 48, 40

Bins = list[list[int]]


class _Room:
    """Open containers by the room they have left, for best fit."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []

    def add(self, room: int, which: int) -> None:
        insort(self.keys, (room, which))

    def best(self, size: int) -> int | None:
        at = bisect_left(self.keys, (size, -1))
        return self.keys.pop(at)[1] if at < len(self.keys) else None


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int, *, ordered: bool = False) -> Bins:
    """Puts the items, largest first (or as they come, if ``ordered``), where least room stays; opens containers where none fits."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    room = _Room()
    for k, f in enumerate(fill):
        if f < capacity:
            room.add(capacity - f, k)
    for i in items if ordered else sorted(items, key=lambda i: (-sizes[i], i)):
        k = room.best(sizes[i])
        if k is None:
            k = len(bins)
            bins.append([])
            fill.append(0)
        bins[k].append(i)
        fill[k] += sizes[i]
        if fill[k] < capacity:
            room.add(capacity - fill[k], k)
    return bins


def random_start(sizes: list[int], capacity: int, rnd: random.Random) -> Bins:
    items = list(range(len(sizes)))
    rnd.shuffle(items)
    return best_fit(sizes, items, [], capacity, ordered=True)


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer containers, then fuller ones: the mean of the squared fills."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def exchange(sizes: list[int], bins: Bins, loose: list[int], capacity: int) -> list[int]:
    """One or two items of a container change places with one or two loose ones that fill it better; what is loose then."""
    size = sizes.__getitem__
    free = sorted(loose, key=size)

    def pairs() -> list[tuple[int, int, int]]:
        return sorted((size(a) + size(b), a, b) for x, a in enumerate(free) for b in free[x + 1 :]) if len(free) <= PAIRED else []

    two = pairs()
    for b in bins:
        room = capacity - sum(map(size, b))
        if room <= 0 or not free:
            continue
        best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
        n = len(b)
        outs = [(size(b[x]), (x,)) for x in range(n)]
        if n <= PAIRED:
            outs += [(size(b[x]) + size(b[y]), (x, y)) for x in range(n) for y in range(x + 1, n)]
        for s, o in outs:
            k = bisect_right(free, s + room, key=size) - 1
            if k >= 0 and size(free[k]) - s > best[0]:
                best = (size(free[k]) - s, o, (free[k],))
            if two:
                k = bisect_right(two, (s + room, len(sizes))) - 1
                if k >= 0 and two[k][0] - s > best[0]:
                    best = (two[k][0] - s, o, two[k][1:])
            if best[0] == room:
                break
        if best[0]:
            gone = [b[x] for x in best[1]]
            b[:] = [i for x, i in enumerate(b) if x not in best[1]] + list(best[2])
            for i in best[2]:
                free.remove(i)
            for i in gone:
                insort(free, i, key=size)
            two = pairs()
    return free


def crossover(sizes: list[int], into: Bins, of: Bins, capacity: int, rnd: random.Random) -> Bins:
    """Whole well-filled containers of one parent are injected into the other."""
    full = sorted(of, key=lambda b: -sum(sizes[i] for i in b))[: max(1, len(of) * 3 // 4)]
    injected = rnd.sample(full, min(len(full), max(1, min(len(of) // 8, INJECTED))))
    taken = {i for b in injected for i in b}
    bins, displaced = [list(b) for b in injected], []
    for b in into:
        if taken.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(sizes, exchange(sizes, bins, displaced, capacity), bins, capacity)


def mutate(sizes: list[int], bins: Bins, capacity: int, rnd: random.Random) -> Bins:
    """Empties the loosest two containers and a few others, and packs their items anew."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[:2]) | {rnd.choice(order) for _ in range(4)}
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    return best_fit(sizes, exchange(sizes, kept, [i for k in gone for i in bins[k]], capacity), kept, capacity)


def least(sizes: list[int], capacity: int) -> int:
    """No packing takes fewer containers."""
    return -(-sum(sizes) // capacity)


def evolve(sizes: list[int], capacity: int, seeds: list[Bins], rnd: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Bins, int]:
    """The best solution after some generations from the seeds and random starts, and how many crossovers were made."""
    rank = lambda b: fitness(sizes, b, capacity)
    people = [b for b in seeds if b]
    people += [random_start(sizes, capacity, rnd) for _ in range(max(2, population) - len(people))]
    made = 0
    for g in range(generations):
        if g >= ALWAYS and len(people[0]) <= least(sizes, capacity):
            break
        a, b = rnd.sample(people, 2)
        child = crossover(sizes, a, b, capacity, rnd)
        made += 1
        people = sorted([*people, child, mutate(sizes, child, capacity, rnd)], key=rank, reverse=True)[:population]
    return max(people, key=rank), made


def _labels(bins: Bins, n: int) -> list[int]:
    """The container of each item."""
    at = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            at[i] = k
    return at


def _bins(labels: list[int] | None) -> Bins:
    if not labels:
        return []
    bins: Bins = [[] for _ in range(max(labels) + 1)]
    for i, k in enumerate(labels):
        bins[k].append(i)
    return bins


_ITEMS = "shard bigint, keys array<bigint>, parts array<int>, sizes array<int>"
_STATE = "shard bigint, island int, sizes array<int>, own array<int>, guest array<int>, bins int, settled boolean, crossovers bigint"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_INTS = pa.list_(pa.int32())


def _gather(t: pa.Table) -> pa.Table:
    """One row a shard, with all its items in a fixed order."""
    size, key, part = (t[c].to_numpy() for c in ("n_tokens", "doc", "piece"))
    at = np.lexsort((part, key, -size))
    return pa.table([pa.array([t["shard"][0].as_py()]), *[pa.array([x[at].tolist()], pa.list_(k)) for x, k in ((key, pa.int64()), (part, pa.int32()), (size, pa.int32()))]], names=["shard", "keys", "parts", "sizes"])


def _epoch(capacity: int, epoch: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = r["sizes"]
                seeds = [_bins(r["own"]), _bins(r["guest"])]
                if last and r["island"] == 0:
                    seeds.append(best_fit(sizes, list(range(len(sizes))), [], capacity))
                found, made = evolve(sizes, capacity, seeds, random.Random(f"{r['shard']}/{r['island']}/{epoch}"))
                settled = len(found) <= least(sizes, capacity) or last
                row = [r["shard"], r["island"], None if settled else sizes, _labels(found, len(sizes)), None, len(found), settled, r["crossovers"] + made]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), _INTS, _INTS, _INTS, pa.int32(), pa.bool_(), pa.int64()))], _NAMES)

    return run


def _migrate(t: pa.Table) -> pa.Table:
    """Each island's guest is the best solution of the island before it."""
    t = t.take(pa.array(np.argsort(t["island"].to_numpy())))
    own = t["own"].to_pylist()
    return t.set_column(t.schema.get_field_index("guest"), "guest", pa.array(own[-1:] + own[:-1], _INTS))


_PLACED = "shard bigint, doc bigint, piece int, n_tokens int, bin int, loose boolean"


def _places(capacity: int, loosest: int):
    """Items of each shard with their containers, in Arrow; loose are those of the few loosest containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                keys, parts, sizes, label = (row[c].flatten() for c in ("keys", "parts", "sizes", "own"))
                at = label.to_numpy()
                fill = np.bincount(at, sizes.to_numpy())
                low = np.zeros(len(fill), bool)
                few = np.argsort(fill, kind="stable")[:loosest]
                low[few] = fill[few] < LOOSE * capacity
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"][0].as_py(), np.int64)), keys, parts, sizes, label, pa.array(low[at])], ["shard", "doc", "piece", "n_tokens", "bin", "loose"])

    return run


def solutions(items: DataFrame, shards: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Items (doc, piece, n_tokens) by shard, and the solution of each shard: labels, containers, crossovers made, epochs taken."""
    gathered = written(items.withColumn("shard", F.pmod(F.xxhash64("doc", "piece"), F.lit(shards))).groupBy("shard").applyInArrow(_gather, _ITEMS), "shards")
    none = F.lit(None).cast("array<int>")
    state = gathered.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "sizes", none.alias("own"), none.alias("guest"), F.lit(0).alias("bins"), F.lit(False).alias("settled"), F.lit(0).cast("bigint").alias("crossovers"))
    done: DataFrame | None = None
    for epoch in range(EPOCHS):
        # few islands a task, however small their rows: evolving is what takes time, and adaptive coalescing goes by size
        tasks = max(1, min(shards * ISLANDS // A_TASK, TASKS))
        state = state.repartition(tasks, "shard", "island").mapInArrow(_epoch(capacity, epoch, epoch == EPOCHS - 1), _STATE)
        state = written(state, "islands")
        best = state.groupBy("shard").agg(F.max_by(F.struct("own", "bins"), F.struct(-F.col("bins"), -F.col("island"))).alias("b"), F.max("settled").alias("settled"), F.sum("crossovers").alias("crossovers"))
        ready = best.where("settled").select("shard", "b.own", "b.bins", "crossovers", F.lit(epoch + 1).alias("epochs"))
        done = ready if done is None else done.unionByName(ready)
        if epoch == EPOCHS - 1:
            break
        open_ = best.where("not settled").select("shard")
        if open_.isEmpty():
            break
        state = state.join(open_, "shard", "left_semi").groupBy("shard").applyInArrow(_migrate, _STATE)
    return gathered, done


def _packed(items: DataFrame, shards: int, capacity: int, loosest: int) -> DataFrame:
    """Items (doc, piece, n_tokens) with shard and bin; loose tells of the few containers that are emptied again."""
    gathered, done = solutions(items, shards, capacity)
    return gathered.join(done.select("shard", "own"), "shard").select("shard", "keys", "parts", "sizes", "own").mapInArrow(_places(capacity, loosest), _PLACED)


def pieces(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """doc, piece, n_tokens: one row an item, or a piece of an item longer than the capacity: full pieces and a rest."""
    base = sized.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"))
    cut = base.select("doc", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int"))).alias("piece"))
    return cut.select("doc", "piece", F.least(F.lit(capacity), F.greatest(F.col("n"), F.lit(0)) - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def fill_containers(sized: DataFrame, key: str, size: str, capacity: int, rows: int, *, shard: int = SHARD) -> DataFrame:
    """key, piece, container, n_tokens: every item, or piece of an item longer than the capacity, in one container.

    ``sized`` has one row an item; ``rows`` is about how many, from which the number of shards follows. An item is cut only
    if it exceeds the capacity: into full pieces and a rest. Items of size 0 or null take no room: they come out with piece 0
    and a null container. Repeated rows are items of their own. The
    result doesn't depend on the order or partitioning of the rows.
    """
    cut = written(pieces(sized, key, size, capacity), "sizes")
    none = cut.where("n_tokens <= 0").select("doc", "piece", F.lit(None).cast("string").alias("container"), "n_tokens")
    # pieces that fill a container; like ones of repeated rows are counted, and numbered to stay apart
    alike = cut.where(F.col("n_tokens") == capacity).groupBy("doc", "piece").agg(F.count(F.lit(1)).alias("n"))
    full = alike.select("doc", "piece", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    full = full.select("doc", "piece", F.concat_ws("-", F.lit("f"), "doc", "piece", "i").alias("container"), F.lit(capacity).alias("n_tokens"))
    first = written(_packed(cut.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity)), max(1, round(rows / shard)), capacity, LOOSEST), "packed")
    name = lambda tag: F.concat_ws("-", F.lit(tag), "shard", "bin").alias("container")
    tight = first.where("not loose").select("doc", "piece", name("s"), "n_tokens")
    # few: the loosest containers of each shard
    again = first.where("loose").select("doc", "piece", "n_tokens")
    second = _packed(again, max(1, round(again.count() / shard)), capacity, 0).select("doc", "piece", name("t"), "n_tokens")
    out = tight.unionByName(second).unionByName(full).unionByName(none)
    return out.select(F.col("doc").alias(key), "piece", "container", "n_tokens")


def _bounds(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = r["sizes"]
                row = [r["shard"], len(sizes), least(sizes, capacity), len(best_fit(sizes, list(range(len(sizes))), [], capacity)), r["bins"], r["crossovers"], r["epochs"]]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], ["shard", "n_items", "bound", "best_fit", "containers", "crossovers", "epochs"])

    return run


def evolution(sized: DataFrame, key: str, size: str, capacity: int, rows: int, *, shard: int = SHARD) -> DataFrame:
    """shard, n_items, bound (no packing takes fewer), best_fit (containers of the sorted best fit), containers, crossovers, epochs.

    A report on the first pass of :func:`fill_containers`; crossovers are those of all islands, epochs those until it was settled.
    """
    cut = pieces(sized, key, size, capacity).where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    gathered, done = solutions(cut, max(1, round(rows / shard)), capacity)
    return gathered.join(done, "shard").select("shard", "sizes", "bins", "crossovers", "epochs").mapInArrow(_bounds(capacity), "shard bigint, n_items bigint, bound bigint, best_fit bigint, containers bigint, crossovers bigint, epochs bigint")
