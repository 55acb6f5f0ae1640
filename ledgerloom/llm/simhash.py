"""SimHash near-dedup by anchor-point covering.

A fingerprint of 64 bits is cut into three segments (22, 21 and 21 bits).  The
anchors of a segment are the code words of the perfect binary Golay code of
length 23: every 23-bit word has exactly one anchor within distance 3 (the
covering radius), its home.  Two fingerprints that differ in at most 4 bits differ
in at most one bit of some segment (with pairs of segments: in at most two bits of
some pair), so the home of one of them lies within covering radius plus that
threshold of the other.  Each fingerprint is therefore replicated to every anchor
within radius plus threshold, and per anchor those at home are compared with all.

Equal fingerprints are one node throughout (copies are never paired), a bucket
gives a spanning forest of its links instead of all pairs, and buckets over
BUCKET rows are split into cells of chunk against chunk, so no task ever holds
more than two chunks.  Up to PAIRS distinct fingerprints the anchors of single
segments are used (2^12 each, about 5 replicas), beyond that those of pairs
(2^24 each, about 60 replicas); both find every link, only the cost differs.
Components come from alternating smallest-neighbour joins.

Null texts count as empty; a text without words has fingerprint zero and is linked
like any other.  Repeated rows stay repeated.  Null doc_ids keep their row; a
component's id is its smallest doc_id that isn't null (null if there is none).
Columns named like the results are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append, cut, fewer, joined, lean, stored, texts

SHINGLE, MOST_BITS = 4, 4
#: Rows of an anchor's bucket that one task takes whole; distinct fingerprints from which pairs of segments are used.
BUCKET, PAIRS = 20_000, 8_000_000
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0b101011100011
RADIUS = 3


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 hashes (seed 42) of the text's word shingles, repeats included."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    words = raw.split()  # bytes: the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    k = max(1, len(words) - shingle + 1)
    first, last = starts[:k].tolist(), (starts[min(shingle, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, k, 65_536):
        h = np.array([digest(line[a:b], 42) for a, b in zip(first[i : i + 65_536], last[i : i + 65_536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit number."""

    def make():
        return lambda batch: [np.array([fingerprint(x) for x in texts(batch, text)], dtype=np.uint64).view(np.int64)]

    return append(docs, T.StructType([T.StructField(name, T.LongType())]), make)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator: 11 bits, zero for code words."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


@lru_cache(maxsize=4)
def patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to most, sorted by syndrome; their weights; where each syndrome begins."""
    all_ = [(sum(1 << b for b in bits), k) for k in range(most + 1) for bits in combinations(range(23), k)]
    e, w = np.array([x[0] for x in all_], dtype=np.int64), np.array([x[1] for x in all_], dtype=np.int64)
    s = syndrome(e)
    order = np.lexsort((w, s))
    return e[order], w[order], np.searchsorted(s[order], np.arange(2049))


def anchors_of(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, distance) for every anchor within most of each word."""
    e, w, begin = patterns(most)
    s = syndrome(words)
    count = begin[s + 1] - begin[s]
    row = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[s][row]
    return row, words[row] ^ e[at], w[at]


def placements(fps: np.ndarray, together: int = 1, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, at home) of every fingerprint, with the anchors of so many segments together as a bucket."""
    u = fps.view(np.uint64)
    extra = most_bits * together // len(SEGMENTS)
    out = []
    for which, group in enumerate(combinations(SEGMENTS, together)):
        row, key, spent = np.arange(len(fps)), np.full(len(fps), which, dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
        home = np.ones(len(fps), dtype=bool)
        for first, width in group:
            words = (u >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
            r, anchor, distance = anchors_of(words[row], RADIUS + extra)
            spent, home = spent[r] + np.maximum(0, distance - RADIUS), home[r] & (distance <= RADIUS)
            keep = spent <= extra
            row, key, spent, home = row[r][keep], (key[r] << 23 | anchor)[keep], spent[keep], home[keep]
        out.append((row, key, home))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(at_home: np.ndarray, all_: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within most_bits between the fingerprints at home and all."""
    label = np.arange(len(all_))
    where = {int(x): i for i, x in enumerate(all_)}
    own: dict[int, int] = {}
    out = []
    u = all_.view(np.uint64)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = int(label[i])
        return i

    for h in at_home:
        hits = np.flatnonzero(np.bitwise_count(u ^ h.view(np.uint64)) <= most_bits)
        if not len(hits):
            continue
        i = where.get(int(h))
        if i is None:  # the home fingerprint belongs to another chunk: its hits are joined through it
            i = own.setdefault(int(h), int(hits[0]))
            out.append((int(h), int(all_[i])))
        me = root(i)
        for j in hits[label[hits] != me]:
            other = root(int(j))
            me = root(me)
            if other != me:
                out.append((int(h), int(all_[j])))
                label[other] = me
            label[j] = me
    return out


def linked(nodes: DataFrame, most_bits: int = MOST_BITS, bucket: int = BUCKET, pairs: int = PAIRS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of nodes (fp, distinct) within most_bits, a spanning forest a bucket."""
    together = 1 if nodes.count() <= pairs else 2

    def place(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 4096):
                row, key, home = placements(fps[i : i + 4096], together, most_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 4096][row]), pa.array(home)], names=["bucket", "fp", "home"])

    placed = nodes.select("fp").mapInArrow(lean(place), "bucket long, fp long, home boolean")
    # counts of the buckets over the limit only: the others need no splitting
    large = placed.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket", F.ceil(F.col("count") / bucket).cast("int").alias("n"))
    if together == 1:
        large = F.broadcast(large)  # three segments of 2^12 anchors: 12,288 rows at most
    sized = placed.join(large, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    # a fingerprint is a partner in column chunk of each row; one at home is also compared from its row chunk with each column
    as_partner = sized.select("bucket", F.explode(every).alias("i"), chunk.alias("j"), "fp", F.lit(False).alias("home"))
    as_home = sized.where("home").select("bucket", chunk.alias("i"), F.explode(every).alias("j"), "fp", F.lit(True).alias("home"))

    def compare(batches):
        last, parts = None, []

        def done():
            if not parts:
                return []
            fps, home = (np.concatenate(x) for x in zip(*parts))
            return links(fps[home], fps[~home], most_bits) if home.any() else []

        def batch_of(edges):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

        for b in batches:
            cell = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            fps, home = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), cell.shape[1]]
            edges = []
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if last != (now := tuple(cell[:, x])):
                    edges += done()
                    last, parts = now, []
                parts.append((fps[x:y], home[x:y]))
            if edges:
                yield batch_of(edges)
        if edges := done():
            yield batch_of(edges)

    cells = as_partner.union(as_home).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(lean(compare), "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn: each node's neighbours are joined to its
    smallest one, until nothing changes; the edges are cut() after each round.
    """
    now = cut(edges.select("a", "b"))
    n = now.count()
    now = fewer(now, n)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.where("b > a")  # larger neighbours to the smallest
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.sum((F.col("b") > F.col("a")).cast("int")).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = fewer(joined(up, low, "a", n), n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = cut(fewer(large.distinct(), n).where("a <> b"))
        n = down.count()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = fewer(joined(down, low2, "a", n), n).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now = cut(fewer(small.distinct(), n))
        n = now.count()
        # done when every node hangs on one root and no root hangs on another
        several = fewer(now.groupBy("a").agg(F.count("*").alias("n")), n).where("n > 1").select("a")
        more = several.union(fewer(now.select("a").join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi"), n))
        if more.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(fewer(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), n))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, bucket: int = BUCKET, pairs: int = PAIRS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    prints = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return grouped(prints, most_bits, bucket, pairs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, most_bits: int = MOST_BITS, bucket: int = BUCKET, pairs: int = PAIRS) -> DataFrame:
    """Rows (doc_id, fp) with their component_id."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(linked(nodes, most_bits, bucket, pairs))
    known = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    best = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of_node = joined(known.select("fp", "root", F.col("n").alias("rows")), best, "root", known.count())
    return joined(prints, of_node.select("fp", "component_id", F.col("rows").alias("n")), "fp", prints.count())


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """docs, of each group of near duplicates the row with the smallest doc_id only (of several the first), with all its columns.

    Null doc_ids come last.  Fingerprints are computed once and stored beside the rows, whose numbers decide what stays.
    """
    rows = stored(with_fingerprints(docs, text, "__simhash").withColumn("__simhash_row", F.monotonically_increasing_id()))
    prints = rows.select(F.col("__simhash").alias("fp"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__simhash_row").alias("row")).alias("first"))
    nodes = cut(prints.groupBy("fp").agg(F.min("first").alias("first")))
    roots = components(linked(nodes, most_bits))
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    stay = known.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("s")).select(F.col("s.row").alias("__simhash_row"))
    return rows.join(stay, "__simhash_row", "left_semi").select(*docs.columns)
