"""N-gram Jaccard join: documents whose sets of word n-grams are nearly the same, by trees over count vectors.

The n-grams of a document are hashed into groups; their counts are a point.  Of two sets
with points p and q at most sum(min(p, q)) n-grams are common, and as many as 9/19 of both
sizes together are needed for a Jaccard similarity of 0.9 (LEAST).  A tree over points has boxes
as nodes, and the same sum with a box's upper corner bounds what any set in it can have in
common with another one.  Pairs that pass the bound are verified on the sets themselves.

The tree's first level is cut so that no query ever needs two of its nodes for a linked pair
to be found, and so that nodes are small: points lie so close in number and so far apart
in each coordinate that boxes made by halving coordinates exclude next to nothing (a point of
256 n-grams has to allow for a difference of 26 over all groups, more than a box's distance
in any few of them).  Instead, the groups are dealt into B bands.  Linked sets differ in T
n-grams at most, so their points are equal, as points, in B - T bands or more.  A node of
the first level is therefore one value of one band's counts (a box without extent in those
coordinates), found by a shuffle on its hash, and a set is in its own node of each band.  A
band with no or one n-gram says little; a set is left out of such nodes as long as fewer
than B - T of its bands are like that, because then another band shows the link.  (If it has
more, so has any set that is equal to it in those only.)  Sizes of linked sets differ by a
tenth at most; T and B go by classes of sizes, and a set near the next class is in both.

Equal sets are one node from the start, known by their digests, so copies are never compared.
Within a first-level node each set is first held against the smallest one, which is enough where a
group of near copies is linked throughout (first in each task, so that a large group
comes as one row a task into its node).  Of nodes that hold several components after that
(of nodes with the same sets, one), the rest of the tree is built (boxes, split at the widest
coordinate, in cells of chunk against chunk where a node is large), and sets of different
components are searched in it.  The pairs found there grow with the square of a group of near
copies, so they stay within the cell, which gives only as many of them as connect the sets they
hold.  Sets that hang together by these are a family; any linked pair that is still missing is
within one.  A family's sets meet once, in cells of bounded size, where all their pairs are
verified and again only those given that connect something.  So every link between sets of
different components is verified, components are exact, and no step gives more rows than its
cells hold.

Handling: null texts count as empty; documents without words are linked with nothing.
Repeated rows stay repeated, and rows with the same doc_id are documents of their own.
Null doc_ids keep their rows; a component's id is its smallest doc_id that isn't null (null if
there is none).  N-grams are told apart by 64-bit hashes, sets by 128-bit ones.
Other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, fewer, joined, lean, sliced, stored, table, texts
from ledgerloom.llm.simhash import components

WORDS = 3
#: Linked if UNION * common >= LEAST * all.
LEAST, UNION = 90, 100
#: Smallest size of the first class, and the ratio between classes (as a fraction).
FIRST, RATIO = 10, (3, 2)
#: Groups of a band.
BAND_GROUPS = 4096
#: Groups of a point: at least so many, and one for so many n-grams.
POINT_GROUPS, PER_GROUP = 64, 32
#: Rows (key, set) that a task combines at a time; sets of a node that a cell takes; points of a leaf.
COMBINED, CELL, LEAF = 1 << 19, 4096, 16
#: Bytes of a family's sets that a cell takes on each side.
PORTION = 1 << 22
#: Sets (or pairs of them) that a task takes at least.
SOME = 1 << 13
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of fewer words, of all together; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, the six ASCII blanks part
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out + h[i : len(h) - k + 1 + i]) * _A
    return np.unique(out)


def differences(a: int, b: int) -> int:
    """Most n-grams that are in one only of two linked sets of these sizes."""
    return (a + b) * (UNION - LEAST) // (UNION + LEAST)


def needed(a, b):
    """Least number of common n-grams of two linked sets, times (UNION + LEAST)."""
    return LEAST * (a + b)


def classes(n: int) -> list[tuple[int, int, int]]:
    """(class, T, B) of each class that a set of this size is in."""
    out, c, low = [], 0, FIRST
    while low * LEAST <= n * UNION:
        high = -(-low * RATIO[0] // RATIO[1])
        if n < high:
            most = differences(high - 1, high - 1)
            out.append((c, most, most + 2 + most // 4))
        c, low = c + 1, high
    return out


def band_keys(h: np.ndarray) -> np.ndarray:
    """The keys of the first-level nodes that a set is in: class, band, and the counts of the band's groups."""
    out = []
    for c, most, bands in classes(len(h)):
        band = (h >> np.uint64(32)) % np.uint64(bands)
        held = np.bincount(band.astype(np.int64), minlength=bands)
        key = np.zeros(bands, dtype=np.uint64)
        np.add.at(key, band.astype(np.int64), mixed((h & np.uint64(BAND_GROUPS - 1)) + band * np.uint64(BAND_GROUPS) + _B))  # the counts' sum over groups, each with a weight of its own
        key = mixed(key + np.arange(bands, dtype=np.uint64) * _C + np.uint64(c) * _A)
        strong = held > 1
        out.append(key if bands - strong.sum() >= bands - most else key[strong])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def point(h: np.ndarray) -> np.ndarray:
    """Counts of a set's groups."""
    groups = max(POINT_GROUPS, 1 << (-(-len(h) // PER_GROUP) - 1).bit_length())
    return np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point over fewer groups."""
    return p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def binary(wide: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as 16 bytes each, in an order that is the numbers'."""
    data = np.ascontiguousarray(wide).byteswap().tobytes()
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(np.arange(0, 16 * len(wide) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def node_of(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), node (the set's digest), n_shingles and point of docs (doc_id, text, h)."""

    def run(batches):
        for b in sliced(batches):
            some = [shingles(x) for x in texts(b)]
            columns = [b.column(0), b.column(2), pa.array([node_of(x) if len(x) else None for x in some], pa.binary()), pa.array([len(x) for x in some], pa.int64()), pa.array([point(x).tobytes() for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "n_shingles", "point"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "h").mapInArrow(lean(run), f"doc_id {kind}, h long, node binary, n_shingles long, point binary")


def _differs(x: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.ones(len(x), dtype=bool)
    out[1:] = (x[1:] != x[:-1]).any(axis=1) if x.ndim > 1 else x[1:] != x[:-1]
    return out


HEAD, SEVERAL, MEMBER = 0, 1, 2


def placed(docs: DataFrame) -> DataFrame:
    """kind, key, leader, node: the first-level nodes of each set, combined within the task.

    A key's smallest set of those that the task has seen together is its HEAD (SEVERAL if there are more), the others are MEMBERs with that leader.
    """
    names = ["kind", "key", "leader", "node"]

    def combined(keys: list[np.ndarray], ids: list[bytes]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        of = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        node = np.frombuffer(b"".join(ids), dtype=">u8").astype(np.uint64).reshape(-1, 2)[of]
        order = np.lexsort((node[:, 1], node[:, 0], key))
        key, node = key[order], node[order]
        begins = _differs(key)
        once = begins | _differs(node)
        key, node, begins = key[once], node[once], begins[once]
        at = np.flatnonzero(begins)
        leader = node[np.repeat(at, np.diff([*at, len(key)]))]
        several = np.repeat(np.diff([*at, len(key)]) > 1, np.diff([*at, len(key)]))
        kind = np.where(begins, np.where(several, SEVERAL, HEAD), MEMBER)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key.view(np.int64)), binary(leader), binary(node)], names=names)

    def run(batches):
        keys, ids, size = [], [], 0
        for b in sliced(batches):
            for x in texts(b):
                h = shingles(x)
                own = band_keys(h)
                if len(own):
                    keys.append(own)
                    ids.append(node_of(h))
                    size += len(own)
                if size >= COMBINED:
                    yield combined(keys, ids)
                    keys, ids, size = [], [], 0
        if keys:
            yield combined(keys, ids)

    return docs.select("text").mapInArrow(lean(run), "kind int, key long, leader binary, node binary")


def gathered(rows: DataFrame) -> DataFrame:
    """key, leader and node of the first-level nodes with several sets: their smallest set (or the task's) beside each one."""
    names = ["key", "leader", "node"]

    def out(key: np.ndarray, leader: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), binary(leader), binary(node)], names=names)

    def run(batches):
        last = None  # key, leader, whether it has been given out, its last node
        for b in batches:
            kind, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            member = kind == MEMBER
            if member.any():
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(member)) for i in (1, 2, 3)], names=names)
            if member.all():
                continue
            key, node, several = key[~member], numbers(b.column(3).filter(pa.array(~member))), kind[~member] == SEVERAL
            given = np.zeros(len(key), dtype=bool)
            if last is not None:  # the key that the batch before ended in goes on
                key, node = np.concatenate([[last[0]], key]), np.concatenate([last[1][None], node])
                several, given = np.concatenate([[last[3]], several]), np.concatenate([[last[2]], given])
            begins = _differs(key)
            at = np.flatnonzero(begins)
            sizes = np.diff([*at, len(key)])
            leader = node[np.repeat(at, sizes)]
            fresh = _differs(node) | begins
            fresh &= begins | (node != leader).any(axis=1)
            whole = np.add.reduceat(fresh.astype(np.int64), at) > 1
            whole |= np.logical_or.reduceat(several, at)
            shown = np.repeat(whole, sizes) & fresh & ~given
            if shown.any():
                yield out(key[shown], leader[shown], node[shown])
            last = (key[-1], leader[-1], bool(whole[-1] or given[at[-1]]), bool(several[at[-1] :].any()))

    deal = F.when(F.col("kind") == MEMBER, F.xxhash64("node")).otherwise(F.col("key"))
    dealt = rows.repartition(deal).sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lean(run), "key long, leader binary, node binary")


class Tree:
    """Points in boxes, halved at the widest coordinate until LEAF are left; a box keeps its upper corner and its smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> None:
        self.points, self.sizes, self.groups = points, sizes, groups
        self.root = self._built(np.arange(len(points)))

    def _built(self, rows: np.ndarray) -> tuple:
        own = self.points[rows]
        high, least = own.max(axis=0), int(self.sizes[rows].min())
        group = int(self.groups[rows[0]]) if (self.groups[rows] == self.groups[rows[0]]).all() else -1
        if len(rows) <= LEAF:
            return high, least, group, rows, None
        widest = int((high - own.min(axis=0)).argmax())
        order = rows[np.argsort(own[:, widest], kind="stable")]
        half = len(order) // 2
        return high, least, group, None, (self._built(order[:half]), self._built(order[half:]))

    def pairs(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of other groups whose points allow for a link."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            (high, least, group, rows, parts), queries = todo.pop()
            near = np.minimum(points[queries], high).sum(axis=1) * (UNION + LEAST) >= needed(sizes[queries], least)
            queries = queries[near & (groups[queries] != group)]
            if not len(queries):
                continue
            if parts is not None:
                todo += [(p, queries) for p in parts]
                continue
            for row in rows:
                common = np.minimum(points[queries], self.points[row]).sum(axis=1)
                hit = queries[(common * (UNION + LEAST) >= needed(sizes[queries], self.sizes[row])) & (groups[queries] != self.groups[row])]
                yield hit, np.full(len(hit), row)


def spanning(pairs: Iterator[tuple[np.ndarray, int]], n: int) -> Iterator[tuple[int, int]]:
    """Those of the pairs (each of some of n sets with one) that connect sets which the ones before don't."""
    part = np.arange(n)
    for some, one in pairs:
        some = some[part[some] != part[one]]
        if len(some):
            apart, first = np.unique(part[some], return_index=True)
            part[np.isin(part, apart)] = part[one]
            yield from ((x, one) for x in some[first].tolist())


def in_cells(rows: DataFrame, key: str, cells: DataFrame, columns: list, found: Callable[..., Iterator[tuple[int, int]]]) -> DataFrame:
    """Distinct pairs (a, b) of nodes that found gives for the rows of each cell; cells: key and cells, the number of chunks of a key's sets.

    A cell is a chunk against another one, or within itself.  found gets the chunks' rows that ask and those that are asked, and
    lists of the columns; a pair is two rows' numbers.
    """
    chunk = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    sized = rows.join(cells, key).withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = sized.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *columns)
    dealt = dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")

    def of_cell(j: int, own: list, node: list, *held: list) -> pa.RecordBatch | None:
        own = np.array(own)
        asked = np.flatnonzero(own == j)
        asking = np.flatnonzero(own != j) if (own != j).any() else asked
        pairs = {(min(node[x], node[y]), max(node[x], node[y])) for x, y in found(asking, asked, *held)} if len(asked) else None
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"]) if pairs else None

    def run(batches):
        now, held = None, None
        for b in sliced(batches):
            for of, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (of, i, j) != now:
                    if held and (x := of_cell(now[2], *held)):
                        yield x
                    now, held = (of, i, j), [[] for _ in row]
                for column, v in zip(held, row, strict=True):
                    column.append(v)
        if held and (x := of_cell(now[2], *held)):
            yield x

    return dealt.mapInArrow(lean(run), "a binary, b binary").distinct()


def searched(rows: DataFrame, cell: int = CELL, whole: bool = True) -> DataFrame:
    """Pairs (a, b) of sets with different roots, in the same first-level node, whose points allow for a link; rows: key, node, root, n, point.

    If not whole, only as many of each cell's pairs as connect the sets that its pairs connect.
    """

    def found(asking: np.ndarray, asked: np.ndarray, root: list, n: list, raw: list) -> Iterator[tuple[int, int]]:
        points = [np.frombuffer(p, dtype="<u2") for p in raw]
        groups = min(map(len, points))
        points = np.stack([folded(p, groups) for p in points])
        sizes, root = np.array(n, dtype=np.int64), np.array(root, dtype=np.int64)
        tree = Tree(points[asked], sizes[asked], root[asked])
        pairs = ((asking[q], int(asked[r[0]])) for q, r in tree.pairs(points[asking], sizes[asking], root[asking]) if len(q))
        return ((x, y) for some, y in pairs for x in some.tolist()) if whole else spanning(pairs, len(points))

    cells = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))
    return in_cells(rows, "key", cells, [F.xxhash64("root").alias("root"), "n", "point"], found)


def linked_sets(some: list[np.ndarray], asking: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Of some sets, those asking that are linked with each one asked.

    What more than half of the sets hold is their base; a set is its difference from it, so that lists of the sets that differ
    in an n-gram are short.  Two sets differ in what is in one only of their differences.
    """
    n = np.array([len(x) for x in some])
    value, at = np.unique(np.concatenate(some), return_inverse=True)
    usual = np.bincount(at, minlength=len(value)) * 2 > len(some)
    base = np.flatnonzero(usual)
    own = [np.concatenate([x[~usual[x]], np.setdiff1d(base, x, assume_unique=True)]) for x in np.split(at, np.cumsum(n)[:-1])]
    size = np.array([len(x) for x in own])
    gram = np.concatenate(own)
    order = np.argsort(gram, kind="stable")
    begins = np.searchsorted(gram[order], np.arange(len(value) + 1))
    holds = np.repeat(np.arange(len(some)), size)[order]
    for y in asked.tolist():
        shared = np.bincount(np.concatenate([holds[:0], *(holds[begins[v] : begins[v + 1]] for v in own[y].tolist())]), minlength=len(some))
        differ, both = size + size[y] - 2 * shared, n + n[y]
        linked = UNION * (both - differ) >= LEAST * (both + differ)  # both - differ: twice what is common
        linked[y] = False
        yield asking[linked[asking]], y


def within(families: DataFrame, known: DataFrame, portion: int = PORTION, cell: int = CELL) -> DataFrame:
    """Links (a, b) between sets of the same family, enough to connect what is linked there; families: node, root, n, known: node, set."""

    def found(asking: np.ndarray, asked: np.ndarray, raw: list) -> Iterator[tuple[int, int]]:
        some = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        return spanning(linked_sets(some, asking, asked), len(some))

    cells = families.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") * 8 / portion), F.ceil(F.count(F.lit(1)) / cell)).cast("int").alias("cells"))
    return in_cells(families.join(known, "node"), "root", cells, ["set"], found)


def bounded(pairs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """The pairs (a, b) whose points allow for a link; count: of the nodes."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")) for c in "ab")
    both = fewer(fewer(pairs.join(a, "a"), count, SOME).join(b, "b").select("a", "b", "na", "nb", "pa", "pb"), count, SOME)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                p, q = np.frombuffer(p, dtype="<u2"), np.frombuffer(q, dtype="<u2")
                groups = min(len(p), len(q))
                keep.append(int(np.minimum(folded(p, groups), folded(q, groups)).sum()) * (UNION + LEAST) >= needed(x, y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(lean(run), "a binary, b binary")


def full_sets(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """node and set (its hashes) of nodes (h, first: their text's hash and one of the doc_ids it has), read from docs again; count: of all nodes."""
    wanted = nodes.select(F.col("h").alias("wanted_h"), F.col("id").alias("wanted_id"))
    found = docs.join(wanted, (F.col("h") == F.col("wanted_h")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")

    def run(batches):
        for b in sliced(batches, 64):
            some = [shingles(x) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in some], pa.binary()), pa.array([x.tobytes() for x in some], pa.binary())], names=["node", "set"])

    return fewer(fewer(found, count, SOME).mapInArrow(lean(run), "node binary, set binary").dropDuplicates(["node"]), count, SOME)


def verified(pairs: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The linked ones of pairs (a, b); count: of the sets."""
    a, b = (known.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = fewer(fewer(pairs.join(a, "a"), count, SOME).join(b, "b").select("a", "b", "set_a", "set_b"), count, SOME)

    def run(batches):
        for batch in sliced(batches, 64):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(UNION * common >= LEAST * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(lean(run), "a binary, b binary")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between sets, enough to connect every component; docs: doc_id, text, h, nodes: node, n, point, h, id."""
    count = nodes.count()
    members = stored(gathered(placed(docs)))
    stars = members.where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    stars = cut(bounded(fewer(stars.distinct(), count, SOME), nodes, count))
    near = fewer(nodes.join(members.select("node").distinct(), "node", "left_semi"), count, SOME)
    known = stored(full_sets(docs, near, count))
    found = cut(verified(stars, known, count))
    roots = components(found)
    placings = members.count()
    labelled = fewer(fewer(members.select("key", "node").distinct(), placings).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), placings)
    members_of = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("t")]  # nodes that agree in these have the same sets
    several = fewer(labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), *members_of).where("x <> y"), placings)
    several = fewer(several.groupBy("c", "s", "t").agg(F.min("key").alias("key")).select("key"), placings)
    rows = fewer(fewer(labelled.join(several, "key"), placings).join(nodes.select("node", "n", "point"), "node"), placings, SOME)
    families = components(searched(rows.select("key", "node", "root", "n", "point"), whole=False))
    return found.union(within(cut(fewer(families.join(nodes.select("node", "n"), "node"), count)), known))


def near_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    own = stored(sets(rows))
    full = own.where("node is not null")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("n_shingles").alias("n"), F.min("point").alias("point"), F.min(F.struct("doc_id", "h")).alias("r")).select("node", "first", "rows", "n", "point", F.col("r.h").alias("h"), F.col("r.doc_id").alias("id")))
    roots = components(cut(links(rows, nodes)))
    count, every = nodes.count(), full.count()
    known = cut(fewer(nodes.select("node", "first", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), count))
    best = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_node = fewer(joined(known.select("node", "root", "rows"), best, "root", count).select("node", "component_id", F.col("rows").alias("n")), count)
    linked = fewer(joined(full.select("doc_id", "n_shingles", "node"), of_node, "node", every), every).select("doc_id", "n_shingles", "component_id")
    return linked.union(own.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(table(spark, sf_dir, "documents"))
