"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed into a
wide vector and the vectors are summed, every entry modulo 2^16.  The sum does not
depend on order, and a paragraph is inserted or deleted by adding or subtracting its
vector.  The vector has two parts:

* STRONG entries from a 512-bit hash of the whole paragraph: equality of multisets.
* WEAK entries of +1 or -1 from the hash of each piece of the paragraph (a few words;
  pieces end where a word's last three bytes say so, inside long runs without blanks where
  three bytes say so, or with the paragraph; no byte outside the word decides) with the number of its occurrence in the text.
  So a repeated piece counts once for each occurrence, not with their square, and pieces
  of blanks don't count.

Likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2) over the weak entries, read as signed
numbers and held within 0 and 1; equal fingerprints have likeness 1.  It estimates
the share of common pieces, 2 |A and B| / (|A| + |B|) over the multisets A and B of
pieces, with a standard error of at most 1 / sqrt(WEAK), about 0.03.

Inserting or deleting needs the number of times that the text already holds a piece,
which a Fingerprint carries (from_text) or is given (from_base64).

The edited text of a document is made from the next one in ascending doc_id order.
Documents are dealt by ranges of (doc_id, hash of the text) whose bounds are found
beforehand from those two numbers alone and sent to all tasks, one pair a partition.
So the row that begins a range is known where it is read, and is sent to the range
before as well: each partition is walked once and needs no other.

Null texts count as empty; an empty text's vector is zero, and likeness between two
empty ones is 1.  Null doc_ids come first (with the least long, if that occurs); rows
with the same doc_id follow each other by their text's hash, so many of them spread over
partitions.  Repeated rows stay repeated and lie together.  A single document is its own next
one.  Other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean, table

STRONG, WEAK = 32, 1024
#: A word ends a piece if its checksum has these low bits set: every fourth on average; three bytes beyond LONG bytes of a word do if theirs have those.
PIECE_MASK, LONG, LONG_MASK = 3, 24, 15
#: Bytes of text that a range holds, about, and ranges at least (as many as the session's shuffle partitions).
RANGE_BYTES = 128 << 20
_BLANK = np.array([c in b"\t\n\v\f\r " for c in range(256)])
_STEPS = np.arange(1, WEAK // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Fingerprint:
    """A multiset of paragraphs as a vector; supports insertion, deletion and comparison."""

    def __init__(self, vector: np.ndarray | None = None, held: Counter | None = None) -> None:
        self.vector = np.zeros(STRONG + WEAK, dtype=np.uint16) if vector is None else vector
        self.held: Counter = Counter() if held is None else held

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        out = cls()
        out.insert(paragraphs(text))
        return out

    @classmethod
    def from_base64(cls, letters: str, held: Counter | None = None) -> Fingerprint:
        """held has the number of times that the text holds each piece; it isn't needed for comparison."""
        return cls(np.frombuffer(base64.b64decode(letters), dtype=">u2").astype(np.uint16), held)

    def copy(self) -> Fingerprint:
        return Fingerprint(self.vector.copy(), self.held.copy())

    def insert(self, some: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in some]
        items = []
        for x in pieces(raw):
            k = self.held[x]
            self.held[x] = k + 1
            items.append(xxhash.xxh3_128_digest(x, k))
        self.vector[:STRONG] += strong(raw)
        self.vector[STRONG:] += weak(items)

    def delete(self, some: list[str]) -> None:
        """Takes paragraphs out that the text holds; raises ValueError where a piece of them isn't known to be held."""
        raw = [p.encode("utf-8", "surrogatepass") for p in some]
        gone = pieces(raw)
        if lacking := Counter(gone) - self.held:
            raise ValueError(f"{sum(lacking.values())} pieces are not held")
        items = []
        for x in gone:
            k = self.held[x] - 1
            self.held[x] = k
            items.append(xxhash.xxh3_128_digest(x, k))
        self.vector[:STRONG] -= strong(raw)
        self.vector[STRONG:] -= weak(items)

    def raw(self) -> bytes:
        return self.vector.astype(">u2").tobytes()

    def base64(self) -> str:
        return base64.b64encode(self.raw()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if (self.vector == other.vector).all():
            return 1.0
        a, b = (x.vector[STRONG:].view(np.int16).astype(np.float64) for x in (self, other))
        whole = float(a @ a + b @ b)
        return min(1.0, max(0.0, 2 * float(a @ b) / whole)) if whole else 0.0


def paragraphs(text: str) -> list[str]:
    return text.split("\n") if text else []


def pieces(some: list[bytes]) -> list[bytes]:
    """The pieces of paragraphs, without the blanks around them; those of blanks only are left out."""
    data = b"\n".join(some) + b"\n"
    b = np.frombuffer(data, dtype=np.uint8)
    blank = _BLANK[b]
    at = np.arange(len(b), dtype=np.int32)
    # first byte of the word that each byte belongs to
    first = np.maximum.accumulate(np.where(blank, at + 1, 0))
    first[1:] = first[:-1]
    first[0] = 0
    size = at - first  # bytes of the word before this one
    ends = np.flatnonzero(blank & (size > 0))
    # a sum over the three bytes before each one that belong to its word: what stands before the word, in this paragraph or another, has no part
    near = np.zeros(len(b), dtype=np.int32)
    for back, weight in ((1, 6), (2, 5), (3, 5)):
        near[back:] += np.where(size[back:] >= back, b[:-back].astype(np.int32) * weight, 0)
    cut = (near[ends] + size[ends] * 7) & PIECE_MASK == PIECE_MASK
    cuts = [ends[cut], np.flatnonzero(b == 10)]
    if size.max() > LONG:
        long = np.flatnonzero((size > LONG) & ~blank)
        cuts.append(long[(near[long] * 40503 >> 4) & LONG_MASK == LONG_MASK])
    edges = np.unique(np.concatenate(cuts)).tolist()
    out, start = [], 0
    for e in edges:
        x = data[start:e].strip()
        if x:
            out.append(x)
        start = e
    return out


def strong(raw: list[bytes]) -> np.ndarray:
    """The sum of the paragraphs' wide hashes."""
    wide = b"".join([hashlib.blake2b(p, digest_size=2 * STRONG).digest() for p in raw])
    return np.frombuffer(wide, dtype="<u2").reshape(-1, STRONG).sum(axis=0, dtype=np.uint16)


def weak(items: list[bytes]) -> np.ndarray:
    """The sum of the signs that 128-bit hashes are stretched to."""
    out = np.zeros(WEAK, dtype=np.int64)
    h = np.frombuffer(b"".join(items), dtype="<u8").reshape(-1, 2)
    for i in range(0, len(h), 255):
        z = h[i : i + 255, :1] + _STEPS
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) ^ h[i : i + 255, 1:]
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones = np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1).sum(axis=0, dtype=np.uint8)
        out += 2 * ones.astype(np.int64) - len(z)
    return out.astype(np.uint16)


def edited_text(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the beginning of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(text: str, own: Fingerprint, following: str, others: Fingerprint) -> tuple:
    """The edited text's digest, both fingerprints, and the likenesses; the edit is applied to the fingerprint."""
    new = edited_text(text, following)
    kept = text.count("\n", 0, len(text) - len(text) // 2)  # whole paragraphs before the edit
    edited = own.copy()
    edited.delete(paragraphs(text)[kept:])
    edited.insert(paragraphs(new)[kept:])
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return digest, own.raw(), edited.raw(), own.likeness(edited), own.likeness(others)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KIND = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_LEAST = np.iinfo(np.int64).min


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KIND.values(), strict=True)], names=list(_KIND))


def ranges(rows: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The least (doc_id, h) of each range that isn't empty, in order: one pair of numbers a range."""
    keys = rows.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("d"), "h").repartitionByRange(parts, "d", "h")
    least = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("d", "h")).alias("k")).select("k.d", "k.h").collect()
    least = sorted((r.d, r.h) for r in least)
    return np.array([d for d, _ in least], dtype=np.int64), np.array([h for _, h in least], dtype=np.int64)


def range_of(d: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The range of each key, and whether the key is its least one."""
    low, high = np.searchsorted(bounds[0], d, side="left"), np.searchsorted(bounds[0], d, side="right")
    part = low - 1
    least = np.zeros(len(d), dtype=bool)
    same = np.flatnonzero(high > low)  # some range begins with this doc_id
    for a in np.unique(low[same]):
        rows = same[low[same] == a]
        own = bounds[1][a : high[rows[0]]]
        at = np.searchsorted(own, h[rows], side="right") - 1
        part[rows] = a + at
        least[rows] = (at >= 0) & (own[np.maximum(at, 0)] == h[rows])
    return part, least


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES, parts: int | None = None) -> DataFrame:
    """COLUMNS of each document (fingerprints in base64), against its edited text and the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bounds = spark.sparkContext.broadcast(ranges(rows, parts))
    n = max(1, len(bounds.value[0]))

    def place(batches):
        for b in batches:
            d = b.column(0).fill_null(_LEAST).to_numpy(zero_copy_only=False)
            part, least = range_of(d, b.column(2).to_numpy(zero_copy_only=False), bounds.value)
            columns = [pa.array(part, pa.int32()), pa.array(np.zeros(len(part), dtype=bool)), b.column(0), b.column(1), b.column(2)]
            out = pa.RecordBatch.from_arrays(columns, names=["part", "ahead", "doc_id", "text", "h"])
            yield out
            if least.any():  # once more, for the end of the range before
                more = out.filter(pa.array(least))
                yield pa.RecordBatch.from_arrays([pa.array((part[least] - 1) % n, pa.int32()), pa.array(np.ones(more.num_rows, dtype=bool)), *more.columns[2:]], names=out.schema.names)

    dealt = rows.mapInArrow(lean(place), "part int, ahead boolean, doc_id long, text string, h long").repartitionById(n, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "h", "text")

    def walk(batches):
        now, last = None, None
        for b in batches:
            out = []
            for part, ahead, d, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    now, last = part, None
                if ahead and last is None:  # the first row ahead has ended the range
                    continue
                own = Fingerprint.of(x)
                if last is not None:
                    out.append((last[0], len(last[1]), *compared(last[1], last[2], x, own)))
                last = None if ahead else (d, x, own)
            if out:
                yield _batch(out)

    letters = {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}
    return dealt.mapInArrow(lean(walk), COLUMNS).withColumns(letters)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
