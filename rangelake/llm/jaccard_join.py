"""Jaccard self-join of documents on word shingles with a count-vector R-tree.

A document's shingles are hashed into groups; the counts of the groups are a point. No two sets share more than the sum
of the smaller of their counts, group by group, and a box of points shares no more with a set than its upper corner
does, so a tree of such boxes drops most pairs unseen; what survives is compared shingle by shingle.

* Equal sets are one class (two 64-bit sums and the size), so exact copies meet once.
* A pair of the wanted similarity shares one of the first shingles of both, in any order common to all. The order puts
  shingles of crowded bins last (``BINS`` fixed counts from a first pass), so passages that many documents share don't
  bring them together. Documents that share such a shingle are a cell; equal cells are looked at once. Shingles of very
  crowded bins are salted: each pair of salts is a cell of its own.
* Within a cell the tree decides which points may be similar; the spanning stars of these are candidate groups.
* Each member's text travels once to its candidate group (large groups: once to each pair of shares), where the tree and
  the comparison find all links. Only stars and link counts come back, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangelake.llm import packs, words
from rangelake.llm.components import components

SHINGLE = 5
PERCENT = 80
BINS = 1 << 16
#: Documents that should meet in a cell, and members in a share of a candidate group.
CELL = 2048
LEAF = 16
#: Shingles a document of a share has on average at most, and shingles that a task of the comparison holds.
SHARE_SIZE = 256
BUCKET_SHINGLES = 1 << 20
#: Shingles that are compared at a time.
FLAT = 1 << 19
_U = np.uint64


def shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than ``n`` has its whole sequence."""
    data, offsets = words.flat(column)
    for low, high in words.slices(offsets):
        part = words.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, bounds = words.cut(part, offsets[low : high + 1] - offsets[low])
        h = words.hashes(part, starts, ends)
        found, _, owner = words.window_hashes(h, bounds, n)
        edges = np.searchsorted(owner, np.arange(high - low + 1))
        for i in range(high - low):
            size = bounds[i + 1] - bounds[i]
            if size >= n:
                yield np.unique(found[edges[i] : edges[i + 1]])
            elif size:
                yield words.window_hashes(h[bounds[i] : bounds[i + 1]], np.array([0, size]), int(size))[0]
            else:
                yield np.zeros(0, _U)


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> _U(48)).astype(np.int64) % BINS


def crowding(docs: DataFrame, n: int) -> np.ndarray:
    """Per bin, how many more shingles of documents it holds than chance explains. ``BINS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for h in shingles(batch.column(0), n):
                np.add.at(total, _bin(h), 1) if len(h) < 256 else np.add(total, np.bincount(_bin(h), minlength=BINS), out=total)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bin", "n"])

    total = np.zeros(BINS, np.int64)
    for row in docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["bin"]] = row["n"]
    middle = float(np.median(total))
    return np.where(total > middle + 6 * np.sqrt(middle) + 16, total - middle, 0).astype(np.int64)


def _dims(size: int) -> int:
    return 1 << max(4, min(10, int(size // 8).bit_length()))


def _point(h: np.ndarray) -> np.ndarray:
    dims = _dims(len(h))
    return np.bincount((h & _U(dims - 1)).astype(np.int64), minlength=dims).astype(np.uint16 if len(h) < 65536 else np.uint32)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap of sets of sizes a and b whose Jaccard similarity is ``percent`` or more."""
    return -(-(percent * (a + b)) // (100 + percent))


def _fold(points: np.ndarray, dims: int) -> np.ndarray:
    """Counts of fewer groups: groups whose numbers agree in the low bits are one."""
    return points.reshape(*points.shape[:-1], -1, dims).sum(-2, dtype=np.int32)


class Tree:
    """Points of one number of groups, sorted by set size in leaves of ``LEAF``.

    A leaf's box keeps the upper corner and the least size, so one comparison can drop all of its points.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], percent: int) -> None:
        order = np.argsort(sizes[members], kind="stable")
        self.members, self.percent = members[order], percent
        self.sizes = sizes[self.members]
        self.cuts = np.arange(0, len(members), LEAF)
        self.least = self.sizes[self.cuts]
        whole = np.stack([points[i] for i in self.members]).astype(np.int32)
        self.dims = whole.shape[1]
        self.levels = {self.dims: (whole, np.maximum.reduceat(whole, self.cuts))}

    def _level(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        if dims not in self.levels:
            whole = _fold(self.levels[self.dims][0], dims)
            self.levels[dims] = whole, np.maximum.reduceat(whole, self.cuts)
        return self.levels[dims]

    def near(self, size: int, point: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """Members whose sets may be as similar as wanted to a set of this size and point."""
        low = int(np.searchsorted(self.sizes, -(-self.percent * size // 100), "left"))
        high = int(np.searchsorted(self.sizes, 100 * size // self.percent, "right"))
        if low >= high:
            return self.members[:0]
        dims = min(self.dims, len(point))
        points, upper = self._level(dims)
        point = _fold(point, dims)
        leaves = np.arange(low // LEAF, -(-high // LEAF))
        boxes = np.minimum(upper[leaves], point).sum(1) >= needed(size, self.least[leaves], self.percent)
        rows = (leaves[boxes][:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[(rows >= low) & (rows < high)]
        if alive is not None:
            rows = rows[alive[self.members[rows]]]
        return self.members[rows[np.minimum(points[rows], point).sum(1) >= needed(size, self.sizes[rows], self.percent)]]


class Forest:
    """A tree for each number of groups: larger sets are counted in more of them, which keeps the bound sharp."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray], percent: int) -> None:
        self.sizes, self.points = sizes, points
        dims = np.array([len(p) for p in points])
        self.trees = [Tree(np.flatnonzero(dims == d), sizes, points, percent) for d in np.unique(dims)]

    def near(self, which: int, alive: np.ndarray | None = None) -> np.ndarray:
        """Points of sets that may be similar to that of point ``which``, itself included."""
        return np.concatenate([t.near(int(self.sizes[which]), self.points[which], alive) for t in self.trees])


def stars(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that span the groups of points which the trees can't tell apart."""
    out = []
    forest = Forest(sizes, points, percent)
    alive = np.ones(len(sizes), bool)
    for first in range(len(sizes)):
        if not alive[first]:
            continue
        alive[first] = False
        todo = [first]
        while todo:
            found = forest.near(todo.pop(), alive)
            alive[found] = False
            out += [(f, first) for f in found.tolist()]
            todo += found.tolist()
    return out


def profiles(docs: DataFrame, crowded: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, doc_key, size, node, other (two sums that name the set), point, keys (hashes of its cells)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(crowded)  # BINS numbers
    source = docs.select("doc_id", packs.document_key().alias("doc_key"), "text")

    def keys(h: np.ndarray, node: int) -> np.ndarray:
        extra = shared.value[_bin(h)]
        first = np.lexsort((h, np.ceil(np.log2(extra + 1))))[: len(h) - -(-percent * len(h) // 100) + 1]
        h, salts = h[first], 1 + extra[first] // CELL
        if salts.max(initial=1) == 1:
            return h
        each = np.repeat(np.arange(len(h)), salts)
        other = np.arange(len(each)) - np.repeat(np.cumsum(salts) - salts, salts)
        own = node % salts[each]
        pair = np.minimum(own, other) * 1_000_003 + np.maximum(own, other)
        return np.where(salts[each] == 1, h[each], words.mix(h[each] ^ words.mix((pair + 1).astype(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in shingles(batch.column("text"), n):
                node = int(words.mix(h).sum(dtype=_U)) & (2**63 - 1)
                other = int(words.mix(h ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) & (2**63 - 1)
                rows.append((len(h), node, other, _point(h).astype(np.uint32 if len(h) >= 65536 else np.uint16).tobytes(), keys(h, node).tobytes() if len(h) else b""))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("doc_key"), *columns], ["doc_id", "doc_key", "size", "node", "other", "point", "keys"])

    return source.mapInArrow(run, f"doc_id {id_type}, doc_key long, size long, node long, other long, point binary, keys binary")


def _near_sizes(cell: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Rows (sorted by cell and size) with a set of a similar size beside them; the others are similar to none of the cell."""
    near = np.concatenate([[False], (cell[1:] == cell[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:]), [False]])
    return np.flatnonzero(near[1:] | near[:-1])


def _cells(profile: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(cell, node) of the cells that two nodes of similar size or more share; cells of the same nodes are one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = words.flat(batch.column("keys"))
            key = np.frombuffer(raw.tobytes(), _U)
            node, size = (np.repeat(batch.column(c).to_numpy(), np.diff(at) // 8) for c in ("node", "size"))
            order = np.lexsort((node, key))
            key, node, size = key[order], node[order], size[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            rows = pa.record_batch([(key[new] % _U(buckets)).astype(np.int64), key[new], node[new], size[new]], ["bucket", "key", "node", "size"])
            found = list(packs.by_key(rows, "bucket")) if rows.num_rows else []
            yield pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([packs.pack(r) for _, r in found], pa.binary())], ["bucket", "pack"])

    def meet(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([packs.unpack(p) for p in table.column("pack").combine_chunks()])
        key, node, sizes = (rows.column(c).to_numpy() for c in ("key", "node", "size"))
        order = np.argsort(key, kind="stable")
        key, node, sizes = key[order], node[order], sizes[order]
        _, size = np.unique(key, return_counts=True)
        shared = np.repeat(size > 1, size)  # only these need their nodes told apart
        key, node, sizes = key[shared], node[shared], sizes[shared]
        order = np.lexsort((node, sizes, key))
        key, node, sizes = key[order], node[order], sizes[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, sizes = key[new], node[new], sizes[new]
        kept = _near_sizes(key, sizes, percent)
        key, node = key[kept], node[kept]
        if not len(key):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["cell", "node"])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        cell = (np.add.reduceat(words.mix(node.astype(_U) ^ _U(0x2545F4914F6CDD1D)), first) >> _U(1)).astype(np.int64)
        _, once = np.unique(cell, return_index=True)
        keep = np.zeros(len(first), bool)
        keep[once] = True
        keep &= size > 1
        rows_kept = np.repeat(keep, size)
        return pa.table([np.repeat(cell, size)[rows_kept], node[rows_kept]], ["cell", "node"])

    sent = profile.where("size > 0").select("node", "size", "keys").mapInArrow(send, "bucket int, pack binary")
    return sent.groupBy("bucket").applyInArrow(meet, "cell long, node long").distinct()


def _read_points(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(p.as_buffer(), np.uint32 if s >= 65536 else np.uint16) for p, s in zip(table.column("point").combine_chunks(), table.column("size").to_pylist())]


def _leaf_pairs(cell: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of rows of one cell (cells of up to ``LEAF`` rows, sorted by cell and size) that pass the bound."""
    dims = np.array([len(p) for p in points])
    place = np.zeros(len(points), np.int64)
    levels = {}
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        place[own] = np.arange(len(own))
        levels[d] = np.stack([points[i] for i in own]).astype(np.int32)
    out = []
    for step in range(1, LEAF):
        low = np.flatnonzero((cell[:-step] == cell[step:]) & (100 * sizes[:-step] >= percent * sizes[step:]))
        kinds = np.stack([dims[low], dims[low + step]])
        for small, large in np.unique(kinds, axis=1).T:
            some = low[(kinds[0] == small) & (kinds[1] == large)]
            for part in np.array_split(some, len(some) * large // FLAT + 1):
                shared = np.minimum(levels[small][place[part]], _fold(levels[large][place[part + step]], small)).sum(1)
                passed = part[shared >= needed(sizes[part], sizes[part + step], percent)]
                out.append(np.stack([passed, passed + step]))
    return np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)


def _candidates(cells: DataFrame, nodes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (u, v) that join what the bound leaves of each cell: cells of a leaf at once, larger ones by their trees."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("size", "ascending")])
        cell, sizes = table.column("cell").to_numpy(), table.column("size").to_numpy()
        kept = _near_sizes(cell, sizes, percent)
        table = table.take(pa.array(kept))
        cell, sizes, node, points = cell[kept], sizes[kept], table.column("node").to_numpy(), _read_points(table)
        cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
        count = np.diff(cuts)
        small = np.flatnonzero(np.repeat(count <= LEAF, count))
        pairs = small[_leaf_pairs(cell[small], sizes[small], [points[i] for i in small], percent)]
        edges = {(int(a), int(b)) for a, b in node[pairs].T}
        for low, high in zip(cuts[:-1][count > LEAF], cuts[1:][count > LEAF]):
            edges.update((int(node[low + a]), int(node[low + b])) for a, b in stars(sizes[low:high], points[low:high], percent))
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    placed = cells.join(nodes.select("node", "size", "point"), "node").withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int"))
    return placed.groupBy("bucket").applyInArrow(run, "u long, v long")


def _links(members: DataFrame, docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(node, root, links): per share pair of a candidate group, spanning stars of the links and how many rows a node links to."""
    share = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    spread = members.withColumn("_own", share).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)))
    placed = spread.select("doc_key", "node", "weight", F.col("_own").alias("share"), F.xxhash64("root", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("task"), (F.col("_own") == F.col("_other")).alias("alone"))
    texts = docs.select(packs.document_key().alias("doc_key"), "text")

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        tasks = table.column("task").to_numpy()
        for task in np.unique(tasks):
            rows = table.filter(pa.array(tasks == task))
            node, first = np.unique(rows.column("node").to_numpy(), return_index=True)  # repeated rows of one document
            rows = rows.take(pa.array(first))
            out += _group_links(list(shingles(rows.column("text").combine_chunks(), n)), node, rows.column("weight").to_numpy(), rows.column("share").to_numpy(), not rows.column("alone")[0].as_py(), percent)
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["node", "root", "links"])

    # one plan for all sizes: candidates grow with the documents, so they are never sent to all tasks
    return texts.join(placed.hint("merge"), "doc_key").withColumn("bucket", F.pmod("task", F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "node long, root long, links long")


def _group_links(sets: list[np.ndarray], node: np.ndarray, weight: np.ndarray, share: np.ndarray, across: bool, percent: int) -> list[tuple[int, int, int]]:
    """All links among the sets (``across``: between the two shares only)."""
    sizes = np.array([len(s) for s in sets])
    parent, links = list(range(len(sets))), np.zeros(len(sets), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = Forest(sizes, [_point(s) for s in sets], percent)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(dense) + 1, bool)
    for a in range(len(sets)):
        found = forest.near(a)
        found = found[found > a]
        if across:
            found = found[share[found] != share[a]]
        mine = dense[at[a] : at[a + 1]]
        marked[mine] = True
        parts = np.flatnonzero(np.diff(np.cumsum(sizes[found]) // FLAT)) + 1  # bounds the flat index
        for part in np.split(found, parts) if len(found) else ():
            size = sizes[part]
            base = np.cumsum(size) - size
            flat = np.arange(size.sum()) - np.repeat(base - at[part], size)
            overlap = np.add.reduceat(marked[dense[flat]].astype(np.int64), base)
            others = part[overlap >= needed(sizes[a], size, percent)]
            links[a] += weight[others].sum()
            links[others] += weight[a]
            for b in others.tolist():
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        marked[mine] = False
    return [(int(node[i]), int(node[root(i)]), int(links[i])) for i in range(len(sets)) if links[i]]


def _joined(docs: DataFrame, n: int, percent: int, cell: int) -> DataFrame:
    """doc_id, doc_key, group (null without shingles) and the results of ``join``."""
    spark = docs.sparkSession
    profile = packs.stored(profiles(docs, crowding(docs, n), n, percent))
    # a document's key, the smallest id, the number of rows and the point of each distinct set
    nodes = profile.where("size > 0").groupBy("node", "other", "size").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.min("doc_key").alias("doc_key"), F.min("point").alias("point"),
    )
    buckets = packs.block_count(profile.agg(F.sum(F.octet_length("keys")).alias("n")).first()["n"] or 0, 2 << 20)
    groups = components(_candidates(_cells(profile, percent, buckets), nodes, percent, buckets))
    members = groups.join(nodes.select("node", "doc_key", "weight", "size"), "node")
    # shares are bounded in documents and in shingles
    shares = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / cell, F.sum("size") / (cell * SHARE_SIZE))).cast("long").alias("shares"))
    members = packs.stored(members.join(shares, "root"))
    compared = members.agg(F.sum(F.col("size") * F.col("shares")).alias("n")).first()["n"] or 0
    links = packs.stored(_links(members, docs, n, percent, packs.block_count(compared, BUCKET_SHINGLES)))
    linked = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = linked.join(nodes.select("node", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = nodes.select("node", "other", "size", "least", "weight").join(linked, "node", "left").join(least, "root", "left").join(counts, "node", "left").select(
        "node", "other", "size", F.coalesce("root", "node").alias("group"), F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    full = profile.select("doc_id", "doc_key", "node", "other", "size").join(answer, ["node", "other", "size"], "left")
    return full.select(
        "doc_id", "doc_key", "group", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents it links to, copies included) of every document.

    Words are lower-cased (A-Z) runs of other characters than white space. Null and wordless texts have no shingles,
    link to nothing and are components of their own. Repeated rows are copies of each other; null ids take part but
    name no component. Further columns are left out; an empty table gives an empty table.
    """
    return _joined(docs, n, percent, cell).drop("doc_key", "group")


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """The documents without near duplicates: of each component the one of the smallest id; columns as in ``docs``.

    Documents without shingles stay. Of a component without ids the smallest key stays; of repeated rows one stays.
    """
    inner, names = packs.renamed(docs)
    found = _joined(docs, n, percent, cell)
    first = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")).alias("x")).select(F.col("x.doc_key").alias("_key"), F.lit(True).alias("_sized"))
    empty = found.where("n_shingles = 0").select(F.col("doc_key").alias("_key"), F.lit(False).alias("_sized")).distinct()
    kept = inner.withColumn("_key", packs.document_key()).join(first.unionByName(empty), "_key")
    once = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_copy = 1 OR NOT _sized")
    return packs.restored(once, docs, names)
