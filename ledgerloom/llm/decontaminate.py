"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond
ASCII.  A window is WINDOW consecutive words of a benchmark item (question or answer
text; the whole item where it is shorter).  A text is normalised to its words with
single blanks and scanned once by the automaton; word numbers lead back to the original
text, so that spans are given in its code points.

The automaton's patterns are the items' consecutive blocks of half a window, side by
side: every window holds a whole one, so a place without such a block has no window, and
the automaton has about one node for each character of the benchmark, instead of one for
each character of each window.  Where a block occurs, the few windows around it are looked
up among the benchmark's by a 128-bit digest, at a cost that doesn't grow with the number of
items that hold the block.  Items shorter than a window are patterns themselves.

A benchmark goes to the tasks as one broadcast of at most SLICE_CHARS characters, from
which each Python worker builds its automaton once and keeps it (about 70 bytes a
character).  A larger one is taken slice by slice, one after the other: each slice's hits
are stored by row number, for the documents that have any, and put together at the end.
So neither driver nor tasks ever hold more than a slice.

Null texts have no words; null items and items without words match nothing;
null item_ids are left out of the item list but their windows still hit.  Items
with the same text all count; repeated item rows count once.  Rows of documents
stay as they are, repeated ones too; columns named like the results are
replaced; an empty table or benchmark gives zero hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append, lean, sliced, stored, texts

WINDOW = 10
SLICE_CHARS = 4_000_000
#: What separates words (everything in ASCII but digits and letters) becomes a blank, A-Z become a-z; a byte stays a byte.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Blocks and short items as patterns, and the holders of each window by its digest."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.window, self.block = window, max(1, window // 2)
        self.found = ahocorasick.Automaton()
        self.holders: dict[bytes, tuple] = {}
        patterns: dict[bytes, int] = {}
        holders: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            own = words(text)
            if not own:
                continue
            if len(own) < window:
                holders[self.digest(own)].add(item)
                patterns[b" " + b" ".join(own) + b" "] = len(own)
                continue
            for i in range(len(own) - window + 1):
                holders[self.digest(own[i : i + window])].add(item)
            for i in range(0, len(own) - self.block + 1, self.block):
                patterns.setdefault(b" " + b" ".join(own[i : i + self.block]) + b" ", self.block)
        # a short item of a block's size is both: its own window is then looked up like the longer ones
        for k, ids in holders.items():
            self.holders[k] = tuple(sorted(i for i in ids if i is not None))
        for p, n in patterns.items():
            self.found.add_word(p.decode("latin-1"), n)
        self.found.make_automaton()

    @staticmethod
    def digest(some: list[bytes]) -> bytes:
        return xxhash.xxh3_128_digest(b" ".join(some))

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """The text's number of words, which of them are hit, and the items with occurring windows."""
        own = words(text)
        hit = np.zeros(len(own), dtype=bool)
        items: set[str] = set()
        if own and len(self.found):
            line = b" " + b" ".join(own) + b" "
            ends, seen = None, -1
            for end, n in self.found.iter(line.decode("latin-1")):
                if ends is None:  # the blank behind word k is the k-th but one
                    ends = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
                last = int(np.searchsorted(ends, end))
                first = last - n
                if (ids := self.holders.get(self.digest(own[first:last]))) is not None:
                    hit[first:last] = True
                    items.update(ids)
                if n != self.block:
                    continue
                # windows that hold the block, without those looked up at the block before
                for i in range(max(0, last - self.window, seen + 1), min(first, len(own) - self.window) + 1):
                    seen = i
                    if (ids := self.holders.get(self.digest(own[i : i + self.window]))) is not None:
                        hit[i : i + self.window] = True
                        items.update(ids)
        return len(own), hit, items


#: The automaton that this Python worker built last, by the name of the slice it is from.
_BUILT: dict[str, Automaton] = {}


def built(name: str, part, window: int) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(part.value, window)
    return _BUILT[name]


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as [start, end) in code points of the original text."""
    if not hit.any():
        return []
    folded = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], folded != 32, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def slices(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = SLICE_CHARS):
    """The benchmark's distinct items, streamed to the driver in slices of bounded size (a larger item is a slice)."""
    part, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    for row in rows.toLocalIterator():
        if part and size + len(row.t) > most:
            yield part
            part, size = [], 0
        part.append((row.i, row.t))
        size += len(row.t)
    yield part


def results(xs: list[str], hits: list[np.ndarray], items: list[set]) -> list[list]:
    """The values of RESULT's columns."""
    names = [",".join(sorted(i)) for i in items]
    return [
        [len(h) for h in hits],
        [int(h.sum()) for h in hits],
        [len(i) for i in items],
        [hashlib.sha256(n.encode()).hexdigest() for n in names],
        [bool(h.any()) for h in hits],
        [sorted(i) for i in items],
        [spans(x, h) for x, h in zip(xs, hits, strict=True)],
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, the items and the hit spans."""
    parts = slices(benchmark, item_id, item_text, slice_chars)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _in_one(docs, docs.sparkSession.sparkContext.broadcast(first), text, window)
    numbered = stored(docs.withColumn("__decontaminate_row", F.monotonically_increasing_id()))
    hits = _hits(numbered, first, text, window)
    for part in chain([second], parts):
        hits = hits.unionByName(_hits(numbered, part, text, window))
    return _put_together(numbered, hits, text, docs.columns)


def _in_one(docs: DataFrame, part, text: str, window: int) -> DataFrame:
    name = uuid.uuid4().hex

    def make():
        def work(batch):
            found = built(name, part, window)
            xs = texts(batch, text)
            seen = [found.scan(x) for x in xs]
            return results(xs, [h for _, h, _ in seen], [i for _, _, i in seen])

        return work

    return append(docs, RESULT, make)


def _hits(numbered: DataFrame, items: list, text: str, window: int) -> DataFrame:
    """Row number, hit words and items of the rows that a slice hits, stored."""
    part, name = numbered.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        found = built(name, part, window)
        for b in sliced(batches):
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, hit, ids = found.scan(x or "")
                if hit.any():
                    rows.append((k, np.packbits(hit).tobytes(), sorted(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.string())), strict=True)], names=["row", "words", "items"])

    out = stored(numbered.select("__decontaminate_row", text).mapInArrow(lean(run), "row long, words binary, items array<string>"))
    part.unpersist()
    return out


def _put_together(numbered: DataFrame, hits: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The result from all slices' hits: at most one row a slice meets each document."""
    by_row = hits.groupBy("row").agg(F.collect_list("words").alias("__all_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__all_items"))
    rows = numbered.join(by_row, F.col("__decontaminate_row") == F.col("row"), "left").select(*columns, "__all_words", "__all_items")

    def make():
        def work(batch):
            xs = texts(batch, text)
            marks, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__all_words", "__all_items"))
            hits = [np.zeros(len(words(x)), dtype=bool) for x in xs]
            for h, some in zip(hits, marks, strict=True):
                for m in some or ():
                    h |= np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool)
            return results(xs, hits, [set(i or ()) for i in ids])

        return work

    return append(rows, RESULT, make).drop("__all_words", "__all_items")
