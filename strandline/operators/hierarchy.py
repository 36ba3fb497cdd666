"""Parent-child links to full hierarchies: paths, depth, roots, descendants and cycles.

Nodes that have no cycle above them form a forest once every node with several parents is unfolded into one occurrence for
each chain that leads to it. Subtree sizes are summed upward, level by level; each occurrence then hands its children
preorder ranges, by prefix sums over their sizes, downward. In these nested sets the root of an occurrence is found by binary
search among the roots' ranges, and ancestors and descendants by containment. Nodes that the downward pass never reaches
are on a cycle or below one; trimmed from below, they leave the cyclic core, whose strongly connected parts are the cycles.

Paths are many more than nodes where nodes have several parents; they are given on a walk in preorder, a batch at a time.

A scope (a file) with at most ``GROUP_ROWS`` rows is worked on in one task, with arrays. Larger scopes are never gathered:
the same passes run over them as joins, one a level, each written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.packed import parse, values_of
from strandline.session import written

#: Rows of a scope up to which one task works on it.
GROUP_ROWS = 1_000_000
#: Occurrences for each node up to which depths and descendants unfold a scope; in a denser one they go link by link, with the
#: same results. Paths are always unfolded.
UNFOLD = 64
#: Occurrences of a scope up to which doubles count them exactly. More, which no table holds, are an error where ranges are wanted.
EXACT = 2**53
#: Rows and bytes of paths in a batch of occurrences.
BATCH_ROWS, BATCH_BYTES = 50_000, 16_000_000

_PLAIN = re.compile(r"[^ \t,;|/\"']+")


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges begin[i] .. begin[i] + count[i] - 1."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - begin, count)


def _countable(paths: float, scope: str | None) -> None:
    if paths > EXACT:
        raise OverflowError(f"{paths:.3g} paths in the scope {scope!r}: more than {EXACT} can't be numbered")


class Forest:
    """Links of one scope: ``child[i]`` has the parent ``parent[i]``, of n nodes; links are distinct."""

    def __init__(self, n: int, child: np.ndarray, parent: np.ndarray):
        self.n = n
        at = np.lexsort((child, parent))
        self.child, self.parent = child[at], parent[at]
        self.first = np.searchsorted(self.parent, np.arange(n + 1))
        self._descend()
        # links of the forest: those below which no cycle is above; the others wait for cycles()
        self.all_child, self.all_parent = self.child, self.parent
        sound = self.level[self.child] >= 0
        self.child, self.parent = self.child[sound], self.parent[sound]
        self.first = np.searchsorted(self.parent, np.arange(n + 1))

    def kids(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links below the nodes, and how many each has."""
        count = self.first[nodes + 1] - self.first[nodes]
        return _ranges(self.first[nodes], count), count

    def _descend(self) -> None:
        """Level of each node below the roots by its longest chain; -1 where a cycle is above."""
        waiting = np.bincount(self.child, minlength=self.n)
        self.level = np.full(self.n, -1, np.int64)
        front, k = np.flatnonzero(waiting == 0), 0
        self.roots = front
        self.by_level = []
        while len(front):
            self.level[front] = k
            self.by_level.append(front)
            k += 1
            links, _ = self.kids(front)
            below = self.child[links]
            np.subtract.at(waiting, below, 1)
            below = np.unique(below)
            front = below[waiting[below] == 0]

    def sizes(self) -> np.ndarray:
        """Subtree size of each node in the unfolded forest, summed upward; a float, so that it can't overflow."""
        size = (self.level >= 0).astype(np.float64)
        for nodes in reversed(self.by_level):
            links, count = self.kids(nodes)
            has = count > 0
            if has.any():
                below = size[self.child[links]]
                starts = (np.cumsum(count) - count)[has]
                size[nodes[has]] += np.add.reduceat(below, starts)
        return size

    def occurrences(self) -> dict[str, np.ndarray]:
        """Nested sets of the unfolded forest: node, depth, lft and size of each occurrence."""
        size = self.sizes().astype(np.int64)
        inner = np.cumsum(size[self.child]) - size[self.child]
        safe = np.minimum(self.first[:-1], max(len(inner) - 1, 0))
        base = inner[safe] if len(inner) else np.zeros(self.n, np.int64)
        node = self.roots
        lft = np.cumsum(size[node]) - size[node] + 1
        parts, depth = [], 0
        while len(node):
            parts.append((node, np.full(len(node), depth, np.int64), lft, size[node]))
            links, count = self.kids(node)
            links_of = np.repeat(np.arange(len(node)), count)
            up_node, up_lft = node[links_of], lft[links_of]
            node = self.child[links]
            lft = up_lft + 1 + inner[links] - base[up_node] if len(links) else links
            depth += 1
        names = ("node", "depth", "lft", "size")
        if not parts:
            return {k: np.zeros(0, np.int64) for k in names}
        return {k: np.concatenate(x) for k, x in zip(names, zip(*parts))}

    def walk(self, names: list[str], scope: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """Batches (node, root, depth, lft, number below, path) of every occurrence in preorder, roots and children by number.

        However many there are, what is held is a batch, the way from a root to the occurrence, and the links.
        """
        size = self.sizes()
        _countable(float(size[self.roots].sum()), scope)
        size, first, child = size.astype(np.int64), self.first.tolist(), self.child.tolist()
        texts = [x.encode() for x in names]
        path, begun = bytearray(), 0
        node, root, depth, ends, data = [], [], [], [0], bytearray()

        def batch():
            at = np.array(node, np.int64)
            paths = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(bytes(data)))
            return at, np.array(root, np.int64), np.array(depth, np.int32), np.arange(begun + 1, begun + 1 + len(at)), size[at] - 1, paths

        for top in self.roots.tolist():
            x, links, cuts, cut = top, [], [], 0  # for each node on the way: its links not yet taken, the length of its path
            while True:
                del path[cut:]
                if links:
                    path += b">"
                path += texts[x]
                if len(node) == BATCH_ROWS or node and len(data) + len(path) > BATCH_BYTES:
                    yield batch()
                    begun += len(node)
                    node, root, depth, ends, data = [], [], [], [0], bytearray()
                node.append(x)
                root.append(top)
                depth.append(len(links))
                data += path
                ends.append(len(data))
                if first[x] < first[x + 1]:
                    links.append(iter(range(first[x], first[x + 1])))
                    cuts.append(len(path))
                while links and (at := next(links[-1], -1)) < 0:
                    links.pop()
                    cuts.pop()
                if not links:
                    break
                x, cut = child[at], cuts[-1]
        if node:
            yield batch()

    def root_of(self, lft: np.ndarray) -> np.ndarray:
        """Root whose range holds each preorder number."""
        size = self.sizes().astype(np.int64)[self.roots]
        begin = np.cumsum(size) - size + 1
        return self.roots[np.searchsorted(begin, lft, "right") - 1]

    def depths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, root, longest chain) of every node without a cycle above."""
        total = float(self.sizes()[self.roots].sum()) if len(self.roots) else 0.0
        if total <= UNFOLD * max(self.n, 1000):
            o = self.occurrences()
            node, root, depth = o["node"], self.root_of(o["lft"]), o["depth"]
        else:  # too many chains to unfold: the longest to each root, level by level
            node, root, depth = self._chains()
        at = np.lexsort((-depth, root, node))
        node, root, depth = node[at], root[at], depth[at]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (root[1:] != root[:-1])
        return node[fresh], root[fresh], depth[fresh]

    def _chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known: dict[int, dict[int, int]] = {}
        up: dict[int, list[int]] = {}
        for c, p in zip(self.child.tolist(), self.parent.tolist()):
            up.setdefault(c, []).append(p)
        for nodes in self.by_level:
            for x in nodes.tolist():
                best = {} if x in up else {x: 0}
                for p in up.get(x, ()):
                    for r, k in known[p].items():
                        if best.get(r, -1) <= k:
                            best[r] = k + 1
                known[x] = best
        flat = [(x, r, k) for x, d in known.items() for r, k in d.items()]
        return tuple(np.array(c, np.int64) for c in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3

    def cycles(self) -> list[list[int]]:
        """The strongly connected parts that hold a cycle."""
        left = self.level < 0
        while True:  # from below: nodes that nothing left points to
            inside = left[self.all_child] & left[self.all_parent]
            core = left & np.isin(np.arange(self.n), self.all_parent[inside])
            if core.sum() == left.sum():
                break
            left = core
        up: dict[int, list[int]] = {}
        for c, p in zip(self.all_child[inside].tolist(), self.all_parent[inside].tolist()):
            up.setdefault(c, []).append(p)
        return strong_parts(up)


def strong_parts(up: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected parts with a cycle, by Tarjan's algorithm without recursion."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    parts = []
    for begin in up:
        if begin in number:
            continue
        number[begin] = low[begin] = len(number)
        stack.append(begin)
        on.add(begin)
        work = [(begin, iter(up[begin]))]
        while work:
            v, rest = work[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(up.get(x, ()))))
                    break
                if x in on:
                    low[v] = min(low[v], number[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or v in up.get(v, ()):
                        parts.append(part)
    return parts


def forest_of(t: pa.Table) -> tuple[Forest, list[str]]:
    """The forest of one scope's rows (id, parent as written), and the nodes' ids."""
    ids = pc.dictionary_encode(t["id"].combine_chunks())
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    names = ids.dictionary.to_pylist()
    number = dict(zip(names, range(len(names))))
    code = ids.indices.to_numpy(zero_copy_only=False)
    texts = pc.dictionary_encode(t["parent"].combine_chunks())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    has = pc.is_valid(texts.indices).to_numpy(zero_copy_only=False)
    text = pc.fill_null(texts.indices, 0).to_numpy(zero_copy_only=False)[has]
    flat, count = [], []
    for s in texts.dictionary.to_pylist():
        vs = [s] if _PLAIN.fullmatch(s) else [v for v, _ in parse(s)[0]]
        known = {number[v] for v in vs if v in number}
        flat += known
        count.append(len(known))
    count, flat = np.array(count, np.int64), np.array(flat, np.int64)
    pairs = np.unique(code[has].astype(np.int64) * max(len(count), 1) + text)
    c, s = pairs // max(len(count), 1), pairs % max(len(count), 1)
    begin = np.cumsum(count) - count
    parent = flat[_ranges(begin[s], count[s])] if len(s) else flat[:0]
    links = np.unique(np.repeat(c, count[s]) * max(len(names), 1) + parent) if len(s) else np.zeros(0, np.int64)
    return Forest(len(names), links // max(len(names), 1), links % max(len(names), 1)), names


def _take(names: list[str], at: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(at, pa.int64()))


def _depths_in(least: int):
    def run(t: pa.Table) -> pa.Table:
        f, names = forest_of(t)
        node, root, depth = f.depths()
        deep = depth >= least
        node, root, depth = node[deep], root[deep], depth[deep]
        on, label = [], []
        for part in f.cycles():
            smallest = min(part, key=lambda x: names[x].encode())
            on += part
            label += [smallest] * len(part)
        node = np.concatenate([node, np.array(on, np.int64)])
        root = np.concatenate([root, np.array(label, np.int64)])
        depth = np.concatenate([depth, np.full(len(on), -1, np.int64)])
        scope = pa.repeat(t["file_id"][0], len(node)) if len(node) else pa.array([], pa.string())
        return pa.table([scope.cast(pa.string()), _take(names, node), _take(names, root), pa.array(depth, pa.int32())], names=["file_id", "feature_id", "root_id", "depth"])

    return run


def _sets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    scope = t["file_id"][0]
    f, names = forest_of(t.sort_by("id"))  # nodes are numbered by their ids, so ranges don't hang on the order of the rows
    text = pa.array(names, pa.string())
    for node, root, depth, lft, below, path in f.walk(names, scope.as_py()):
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(scope, len(node)).cast(pa.string()), text.take(pa.array(node)), text.take(pa.array(root)), pa.array(depth), path, pa.array(lft), pa.array(lft + below), pa.array(below)],
            names=["file_id", "feature_id", "root_id", "depth", "path", "lft", "rgt", "n_below"],
        )


def _reached(f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ancestor, descendant, shortest chain) link by link, for forests too dense to unfold."""
    up = down = np.flatnonzero(f.level >= 0)
    seen, far, parts = up * f.n + down, 0, []
    while len(up):
        links, count = f.kids(down)
        pairs = np.setdiff1d(np.repeat(up, count) * f.n + f.child[links], seen)
        seen, far = np.union1d(seen, pairs), far + 1
        up, down = pairs // max(f.n, 1), pairs % max(f.n, 1)
        parts.append((up, down, np.full(len(up), far, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def _descendants_in(t: pa.Table) -> pa.Table:
    f, names = forest_of(t)
    if float(f.sizes()[f.roots].sum()) > UNFOLD * max(f.n, 1000):
        up, down, far = _reached(f)
        scope = pa.repeat(t["file_id"][0], len(up)).cast(pa.string()) if len(up) else pa.array([], pa.string())
        return pa.table([scope, _take(names, up), _take(names, down), pa.array(far, pa.int32())], names=["file_id", "feature_id", "descendant_id", "distance"])
    o = f.occurrences()
    up_all, down_all, far_all = [], [], []
    for d in range(int(o["depth"].max(initial=-1))):
        here, below = np.flatnonzero(o["depth"] == d), np.flatnonzero(o["depth"] > d)
        here = here[np.argsort(o["lft"][here])]
        at = np.searchsorted(o["lft"][here], o["lft"][below], "right") - 1
        inside = (at >= 0) & (o["lft"][below] <= (o["lft"] + o["size"] - 1)[here[np.maximum(at, 0)]])
        up_all.append(o["node"][here[at[inside]]])
        down_all.append(o["node"][below[inside]])
        far_all.append(o["depth"][below[inside]] - d)
    e = [np.zeros(0, np.int64)]
    up, down, far = (np.concatenate([*x, *e]) for x in (up_all, down_all, far_all))
    at = np.lexsort((far, down, up))
    up, down, far = up[at], down[at], far[at]
    fresh = np.ones(len(up), bool)
    fresh[1:] = (up[1:] != up[:-1]) | (down[1:] != down[:-1])
    up, down, far = up[fresh], down[fresh], far[fresh]
    scope = pa.repeat(t["file_id"][0], len(up)).cast(pa.string()) if len(up) else pa.array([], pa.string())
    return pa.table([scope, _take(names, up), _take(names, down), pa.array(far, pa.int32())], names=["file_id", "feature_id", "descendant_id", "distance"])


_FOUND = "file_id string, feature_id string, root_id string, depth int"


def _rows(df: DataFrame, scope: str, ident: str, parent: str) -> DataFrame:
    return df.where(F.col(ident).isNotNull()).select(F.col(scope).cast("string").alias("file_id"), F.col(ident).alias("id"), F.col(parent).alias("parent"))


def _parted(rows: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of scopes for one task each, and those of larger scopes, if there are any."""
    large = rows.groupBy("file_id").count().where(F.col("count") > group_rows).select("file_id")
    if not large.take(1):
        return rows, None
    large = written(large.select(F.coalesce("file_id", F.lit("")).alias("_large"), F.col("file_id").isNull().alias("_null")), "scopes")
    key = (F.coalesce("file_id", F.lit("")) == F.col("_large")) & (F.col("file_id").isNull() == F.col("_null"))
    return rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi")


def depths(df: DataFrame, scope: str, ident: str, parent: str, *, least: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """file_id, feature_id, root_id, depth: the longest chain of each node to each root it reaches, if it has ``least`` links.

    Nodes are the distinct non-null ids of a scope; links lead to the values of any of a node's parent fields that are nodes
    of the same scope. A node on a cycle gives one row, with depth -1 and the smallest id of its strongly connected part; a
    node below a cycle gives none. A null scope is a scope of its own. Repeated rows and links count once; values that are no
    nodes are no links; an empty table gives no rows; other columns aren't read.
    """
    small, large = _parted(_rows(df, scope, ident, parent), group_rows)
    found = small.groupBy("file_id").applyInArrow(_depths_in(least), _FOUND)
    return found if large is None else found.unionByName(_depths_by_joins(large, least, group_rows))


_SETS = "file_id string, feature_id string, root_id string, depth int, path string, lft bigint, rgt bigint, n_below bigint"


def nested_sets(df: DataFrame, scope: str, ident: str, parent: str, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every occurrence of every node without a cycle above: root, depth, path (ids joined by >), range and size below.

    Ranges run through each scope in preorder, roots and children by their ids. There is a row for each chain from a root, of
    which a scope with many parents a node may have far more than rows; a scope with more than EXACT is an error.
    """
    small, large = _parted(_rows(df, scope, ident, parent), group_rows)
    found = small.groupBy("file_id").applyInArrow(_sets_in, _SETS)
    return found if large is None else found.unionByName(_sets_by_joins(large))


def descendants(df: DataFrame, scope: str, ident: str, parent: str, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each node with each of its descendants and the shortest chain between them, by containment of ranges (in scopes too
    large for one task, link by link)."""
    small, large = _parted(_rows(df, scope, ident, parent), group_rows)
    found = small.groupBy("file_id").applyInArrow(_descendants_in, "file_id string, feature_id string, descendant_id string, distance int")
    return found if large is None else found.unionByName(_descendants_by_joins(large))


# scopes too large for one task


class _Joined:
    """The passes over scopes that are never gathered: each step is a join or an aggregate, each level a written table.

    ``file_id`` is a struct of the scope and whether it is null, so that it can be joined on.
    """

    def __init__(self, rows: DataFrame):
        rows = rows.withColumn("file_id", F.struct(F.coalesce("file_id", F.lit("")).alias("s"), F.col("file_id").isNull().alias("n")))
        self.nodes = written(rows.select("file_id", F.col("id").alias("node")).distinct(), "nodes")
        links = rows.select("file_id", F.col("id").alias("child"), F.explode(values_of("parent")).alias("parent")).distinct()
        links = written(links.join(self.nodes.withColumnRenamed("node", "parent"), ["file_id", "parent"], "left_semi").select("file_id", "child", "parent"), "links")
        tainted = self._peeled(links, "parent", "child")  # links below which a cycle is above
        self.core = self._peeled(tainted, "child", "parent")
        bad = written(tainted.select("file_id", "child").distinct(), "tainted")
        self.links = written(links.join(bad, ["file_id", "child"], "left_anti").select("file_id", "child", "parent"), "sound")
        self.roots = written(self.nodes.join(links.select("file_id", F.col("child").alias("node")).distinct(), ["file_id", "node"], "left_anti"), "roots")

    @staticmethod
    def _peeled(e: DataFrame, keep: str, among: str) -> DataFrame:
        """Links whose ``keep`` end is some link's ``among`` end, again and again until all are."""
        n = e.count()
        while n:
            e = written(e.join(e.select("file_id", F.col(among).alias(keep)).distinct(), ["file_id", keep], "left_semi").select("file_id", "child", "parent"), "peel")
            m = e.count()
            if m == n:
                break
            n = m
        return e

    def _expanded(self, front: DataFrame, columns: list, distinct: bool) -> list[DataFrame]:
        """The front (node, depth, ...) and what it leads to, level by level, while there is any."""
        fronts = [front]
        while fronts[-1].count():
            step = fronts[-1].withColumnRenamed("node", "parent").join(self.links, ["file_id", "parent"]).select("file_id", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), *columns)
            fronts.append(written(step.distinct() if distinct else step, "front"))
        return fronts

    def sized(self) -> DataFrame:
        """Subtree size of each node in the unfolded forest (a double), summed upward from the deepest level."""
        fronts = self._expanded(self.roots.withColumn("depth", F.lit(0)), [], True)
        level = written(reduce(DataFrame.unionByName, fronts).groupBy("file_id", "node").agg(F.max("depth").alias("level")), "levels")
        known = level.limit(0).select("file_id", "node", F.lit(0.0).alias("size"))
        for k in range(len(fronts) - 2, -1, -1):
            here = level.where(F.col("level") == k)
            below = self.links.join(here.select("file_id", F.col("node").alias("parent")), ["file_id", "parent"]).join(known.withColumnRenamed("node", "child"), ["file_id", "child"])
            sums = below.groupBy("file_id", F.col("parent").alias("node")).agg(F.sum("size").alias("_s"))
            done = here.join(sums, ["file_id", "node"], "left").select("file_id", "node", (F.coalesce("_s", F.lit(0.0)) + 1).alias("size"))
            known = written(known.unionByName(done), "sizes")
        return known

    def too_dense(self, size: DataFrame) -> bool:
        total = size.join(self.roots, ["file_id", "node"], "left_semi").agg(F.sum("size")).first()[0] or 0.0
        return total > UNFOLD * max(self.nodes.count(), 1000)

    def countable(self, size: DataFrame) -> None:
        total = size.join(self.roots, ["file_id", "node"], "left_semi").groupBy("file_id").agg(F.sum("size").alias("n")).where(F.col("n") > EXACT).first()
        if total:
            _countable(total.n, None if total.file_id.n else total.file_id.s)

    @staticmethod
    def _before(df: DataFrame, keys: list[str], node: str) -> DataFrame:
        """Adds ``before``: the sum of the sizes of the keys' rows with smaller nodes, in two steps over ranges of keys and
        nodes, so that no key is one task's."""
        df = written(df.repartitionByRange(*keys, node).withColumn("_b", F.spark_partition_id()), "ranges")
        sums = df.groupBy(*keys, "_b").agg(F.sum("size").alias("_t"))
        sums = sums.withColumn("_base", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_t")).drop("_t")
        inner = F.sum("size").over(Window.partitionBy(*keys, "_b").orderBy(node)) - F.col("size")
        return df.withColumn("_inner", inner).join(sums, [*keys, "_b"]).withColumn("before", (F.col("_base") + F.col("_inner")).cast("bigint")).drop("_b", "_base", "_inner")

    def occurrences(self, size: DataFrame) -> DataFrame:
        """Nested sets of the unfolded forest: node, root, depth, path, lft and size of each occurrence."""
        top = self._before(self.roots.join(size, ["file_id", "node"]), ["file_id"], "node")
        front = written(top.select("file_id", "node", F.lit(0).alias("depth"), F.col("node").alias("root"), F.col("node").alias("path"), (F.col("before") + 1).alias("lft"), F.col("size").cast("bigint").alias("size")), "sets")
        placed = self._before(self.links.join(size.withColumnRenamed("node", "child"), ["file_id", "child"]), ["file_id", "parent"], "child")
        placed = written(placed.select("file_id", "child", "parent", "before", F.col("size").cast("bigint").alias("own")), "placed")
        fronts = [front]
        while fronts[-1].count():
            step = fronts[-1].withColumnRenamed("node", "parent").join(placed, ["file_id", "parent"])
            step = step.select("file_id", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), "root", F.concat("path", F.lit(">"), "child").alias("path"), (F.col("lft") + 1 + F.col("before")).alias("lft"), F.col("own").alias("size"))
            fronts.append(written(step, "sets"))
        return reduce(DataFrame.unionByName, fronts)


def _scope() -> Column:
    return F.when(~F.col("file_id.n"), F.col("file_id.s")).alias("file_id")


def _depths_by_joins(rows: DataFrame, least: int, group_rows: int) -> DataFrame:
    j = _Joined(rows)
    size = j.sized()
    if j.too_dense(size):  # without unfolding: all nodes that a chain of exactly so many links leads to from each root
        front = written(j.roots.select("file_id", "node", F.lit(0).alias("depth"), F.col("node").alias("root")), "front")
        o = reduce(DataFrame.unionByName, j._expanded(front, ["root"], True))
    else:
        o = j.occurrences(size)
    longest = o.groupBy("file_id", "node", "root").agg(F.max("depth").alias("depth")).where(F.col("depth") >= least)
    out = longest.unionByName(_strong(j.core, group_rows))
    return out.select(_scope(), F.col("node").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def _sets_by_joins(rows: DataFrame) -> DataFrame:
    j = _Joined(rows)
    size = j.sized()
    j.countable(size)
    o = j.occurrences(size)
    return o.select(_scope(), F.col("node").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_below"))


def _descendants_by_joins(rows: DataFrame) -> DataFrame:
    j = _Joined(rows)
    sound = j.links.select("file_id", F.col("parent").alias("node")).union(j.links.select("file_id", F.col("child").alias("node"))).distinct()
    front = written(sound.select("file_id", "node", F.lit(0).alias("depth"), F.col("node").alias("top")), "front")
    o = reduce(DataFrame.unionByName, j._expanded(front, ["top"], True)).where("depth > 0")
    o = o.groupBy("file_id", "top", "node").agg(F.min("depth").alias("distance"))
    return o.select(_scope(), F.col("top").alias("feature_id"), F.col("node").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def _strong(core: DataFrame, group_rows: int) -> DataFrame:
    """Nodes on cycles with the smallest id of their part: the least ancestor colours what is below it, and of a colour the
    ancestors of its source form one part; parts are taken away until no link is left."""
    done = []
    while core.count():
        nodes = core.select("file_id", F.col("child").alias("node")).union(core.select("file_id", F.col("parent").alias("node"))).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")), "colour")
        while True:
            passed = core.join(colour.withColumnRenamed("node", "parent"), ["file_id", "parent"]).select("file_id", F.col("child").alias("node"), "colour")
            new = written(colour.union(passed).groupBy("file_id", "node").agg(F.min("colour").alias("colour")), "colour")
            changed = new.join(colour.withColumnRenamed("colour", "old"), ["file_id", "node"]).where("colour <> old").limit(1).count()
            colour = new
            if not changed:
                break
        inner = core.join(colour.withColumnRenamed("node", "child"), ["file_id", "child"]).join(
            colour.withColumnRenamed("node", "parent").withColumnRenamed("colour", "c2"), ["file_id", "parent"]
        )
        inner = written(inner.where("colour = c2").select("file_id", "child", "parent", "colour"), "inner")
        # a source that is on a cycle has a link within its colour leading to it from below
        part = written(inner.where("child = colour").select("file_id", F.col("child").alias("node"), "colour").distinct(), "part")
        n = part.count()
        while True:
            up = inner.join(part.withColumnRenamed("node", "child"), ["file_id", "child", "colour"]).select("file_id", F.col("parent").alias("node"), "colour")
            part = written(part.union(up).distinct(), "part")
            m = part.count()
            if m == n:
                break
            n = m
        done.append(part)
        gone = part.select("file_id", "node")
        core = core.join(gone.withColumnRenamed("node", "child"), ["file_id", "child"], "left_anti").join(gone.withColumnRenamed("node", "parent"), ["file_id", "parent"], "left_anti")
        core = written(core.select("file_id", "child", "parent"), "core")
        # sources that are on no cycle go too, or they would colour forever
        idle = colour.where("node = colour").join(gone, ["file_id", "node"], "left_anti").select("file_id", F.col("node").alias("parent"))
        core = written(core.join(idle, ["file_id", "parent"], "left_anti").select("file_id", "child", "parent"), "core")
    if not done:
        return core.select("file_id", F.col("child").alias("node"), F.col("parent").alias("root"), F.lit(-1).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, done).select("file_id", "node", F.col("colour").alias("root"), F.lit(-1).alias("depth"))
