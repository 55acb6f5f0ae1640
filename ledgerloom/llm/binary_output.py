"""Token-ID / binary output: segments of range-coded blocks, written and read by Spark.

Documents are range-partitioned and sorted by doc_id, so file order is document
order.  In each partition the ids of whole documents are gathered into segments of
at least SEGMENT ids.  A segment is one self-contained binary image (layout below)
and one row of a Parquet table: Spark's commit protocol makes the files survive
lost executors and repeated tasks, and they can lie in any store Spark reads (so a
reader opens the Parquet container first; the image inside is the file format).  A
segment's ids are coded in blocks (context_mixing) that start independently from the
segment's prior, each with a CRC-32 of its ids, which reading verifies.

Image, little-endian: 4 bytes "LLT2"; 5 unsigned 32-bit numbers (documents, ids,
blocks, bytes of the tables that follow and their CRC-32); the tables, compressed by
zlib: doc_ids (signed 64), whether each is null (unsigned 8), ids of each document
(unsigned 32), bytes and CRC-32 of each block (unsigned 32 each), the prior
(context_mixing.Prior.dump); then the blocks' codes.

Beside the image a row holds its partition, its number in it, its count of ids and
the count of ids before it in the partition.  A document's start is that plus the
total of the partitions before, one number a partition.

Null texts count as empty: only the end id.  Null doc_ids come first; rows with the
same doc_id follow each other by their text's hash.  Repeated rows are written repeatedly.  Other
columns are left out.  An empty table gives no segments and reads as no rows.  Ids
from 65,536 on raise ValueError, and so does a block whose checksum is wrong.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import context_mixing as cm
from ledgerloom.llm.common import lean, portions, shared_path, sliced
from ledgerloom.llm.token_counts import tokenizer

END_ID = 2
#: Ids of a segment (a longer document makes a longer one), and ids that are coded in step.
SEGMENT, TOGETHER = 1 << 20, 1 << 22
#: Known pre-tokens with their ids that a worker keeps; rows and characters that are split at once.
KNOWN, ROWS, CHARS = 1_000_000, 2048, 4_000_000
MAGIC = b"LLT2"


#: Classes of UTF-8 bytes for the tokenizer's splitting pattern, over ASCII and the Latin-1 letters: letters, digits, other
#: signs, blanks, what stands between texts (a byte that UTF-8 never has), and the first byte of any other character.
LETTER, DIGIT, SIGN, BLANK, BETWEEN, BEYOND = range(6)
_BETWEEN = b"\xff"
_KINDS = np.array(
    [
        BLANK if c in b"\t\n\v\f\r " else DIGIT if 48 <= c <= 57 else LETTER if 65 <= c <= 90 or 97 <= c <= 122 or 128 <= c < 192 or c == 0xC3 else BETWEEN if c == 255 else SIGN if c < 128 else BEYOND
        for c in range(256)
    ],
    dtype=np.uint8,
)


def joined(raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with a byte between them (and some behind), and each text's first byte and end."""
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    return _BETWEEN.join(raw) + 4 * _BETWEEN, first, first + sizes


def beyond(buffer: np.ndarray) -> np.ndarray:
    """Places of characters other than ASCII and the Latin-1 letters."""
    lead = np.flatnonzero(buffer == 0xC3)
    follows = buffer[lead + 1]
    return np.concatenate([np.flatnonzero(_KINDS[buffer] == BEYOND), lead[(follows == 0x97) | (follows == 0xB7)]])


def piece_starts(buffer: np.ndarray) -> np.ndarray:
    """First bytes of all pre-tokens in joined texts, and of what stands between texts.

    A run of one class is a piece.  The last blank of a run before something else is cut off: a
    space begins the following piece, another blank is a piece.  An apostrophe that begins a piece takes
    the letters of a contraction along.
    """
    kinds = _KINDS[buffer]
    start = np.ones(len(buffer), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    last = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] < BLANK))
    start[last] = True
    start[last + 1] = buffer[last] != 32
    at = np.flatnonzero(buffer == 39)
    at = at[start[at]]
    c, d = buffer[at + 1], buffer[at + 2]
    one = at[np.isin(c, np.frombuffer(b"stmd", np.uint8))]
    two = at[((c == ord("r")) & (d == ord("e"))) | ((c == ord("v")) & (d == ord("e"))) | ((c == ord("l")) & (d == ord("l")))]
    start[one + 1], start[two + 1] = False, False
    start[one + 2], start[two + 3] = True, True
    return np.flatnonzero(start)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in plain]
    return {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(rest)}


class PieceEncoder:
    """Ids of whole texts, encoding each distinct pre-token once.

    Ids depend on the pre-token only.  Texts over ASCII and Latin-1 letters are split here, many
    at a time; any other text, and one that holds a special token's string, is encoded whole.  Pre-tokens
    that aren't known yet go to the tokenizer's model one by one.  Known ones and their ids are
    two Arrow columns; beyond KNOWN the half that was used longest ago is forgotten.
    """

    def __init__(self, name: str) -> None:
        self.tok = tokenizer(name)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.known, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())
        self.used, self.turn = np.zeros(0, dtype=np.int64), 0

    def _encode(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").astype("<u2").tobytes() for part in portions(items, 4096) for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> pa.Array:
        """Ids of new pre-tokens; none for what stands between texts."""
        tokenize, items = self.tok.model.tokenize, new.to_pylist()
        whole = b"".join(items).decode("latin-1").translate(self.letters)  # a letter a byte, so that lengths hold
        flat: list[int] = []
        ends, at = [0], 0
        for p in items:
            piece = whole[at : at + len(p)]
            at += len(p)
            if p[0] != 255:
                flat += [t.id for t in tokenize(piece)]
            ends.append(2 * len(flat))
        return pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.array(ends, dtype=np.int32)), pa.py_buffer(np.array(flat, dtype="<u4").astype("<u2"))])

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pre-tokens."""
        if len(self.known) > KNOWN:
            stay = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
            self.known, self.ids, self.used = self.known.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.used[stay]
        # the known ones are looked up in the few asked for: that table is small
        at = pc.index_in(self.known, value_set=pieces)
        places = np.full(len(pieces), -1, dtype=np.int64)
        places[np.asarray(at.drop_null())] = np.flatnonzero(np.asarray(at.is_valid()))
        absent = np.flatnonzero(places < 0)
        if len(absent):
            new = pieces.take(pa.array(absent))
            places[absent] = len(self.known) + np.arange(len(new))
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, self._learn(new)])
            self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
        self.turn += 1
        self.used[places] = self.turn
        return self.ids.take(pa.array(places))

    def _split(self, raw: list[bytes]) -> list[bytes]:
        """Ids of texts over ASCII and Latin-1 letters without special tokens' strings."""
        if not raw:
            return []
        data, first, end = joined(raw)
        buffer = np.frombuffer(data, dtype=np.uint8)
        starts = piece_starts(buffer)
        offsets = np.append(starts, len(buffer)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._of_pieces(pieces.dictionary).take(pieces.indices)
        upto, out = np.frombuffer(ids.buffers()[1], dtype=np.int32), ids.buffers()[2].to_pybytes()
        a, b = (upto[np.searchsorted(starts, x)] for x in (first, end))
        return [out[x:y] for x, y in zip(a.tolist(), b.tolist())]

    def __call__(self, items: list[str]) -> list[bytes]:
        out = [b""] * len(items)
        raw = [x.encode("utf-8", "surrogatepass") for x in items]
        data, first, _ = joined(raw)
        odd = set((np.searchsorted(first, beyond(np.frombuffer(data, dtype=np.uint8)), side="right") - 1).tolist())
        odd |= {i for i, x in enumerate(items) if any(s in x for s in self.special)}
        plain = [i for i in range(len(items)) if i not in odd]
        for i, ids in zip(plain, self._split([raw[i] for i in plain]), strict=True):
            out[i] = ids
        for i, ids in zip(sorted(odd), self._encode([items[i] for i in sorted(odd)]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def piece_encoder(name: str) -> PieceEncoder:
    """A worker's encoder, which keeps what it has learnt from one task to the next."""
    return PieceEncoder(name)


def pack(doc_ids: list[int | None], ids: list[bytes]) -> dict:
    """What image() needs of a segment besides its codes, and its ids."""
    flat = np.frombuffer(b"".join(ids), dtype="<u2")
    return {
        "flat": flat,
        "ids": np.array([0 if d is None else d for d in doc_ids], dtype="<i8"),
        "null": np.array([d is None for d in doc_ids], dtype=np.uint8),
        "sizes": np.array([len(x) // 2 for x in ids], dtype="<u4"),
        "sums": np.array([zlib.crc32(flat[i : i + cm.BLOCK].astype("<u4").tobytes()) for i in range(0, len(flat), cm.BLOCK)], dtype="<u4"),
    }


def image(meta: dict, prior: bytes, codes: list[bytes]) -> bytes:
    tables = zlib.compress(b"".join([*(x.tobytes() for x in (meta["ids"], meta["null"], meta["sizes"], np.array([len(c) for c in codes], dtype="<u4"), meta["sums"])), prior]))
    head = np.array([len(meta["ids"]), len(meta["flat"]), len(codes), len(tables), zlib.crc32(tables)], dtype="<u4")
    return MAGIC + head.tobytes() + tables + b"".join(codes)


class Segment:
    """A parsed image; its blocks are decoded elsewhere, together with those of other segments."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, self.n, blocks, size, crc = np.frombuffer(raw, "<u4", 5, 4).tolist()
        if zlib.crc32(raw[24 : 24 + size]) != crc:
            raise ValueError("a token segment's tables are damaged")
        tables, at = zlib.decompress(raw[24 : 24 + size]), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(tables, kind, count, at)
            at += x.nbytes
            return x

        self.ids, self.null, self.sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
        lengths, self.sums = take("<u4", blocks), take("<u4", blocks)
        self.prior = tables[at:]
        edges = 24 + size + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.codes = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def checked(self, flat: np.ndarray) -> np.ndarray:
        out = flat.astype("<u4")
        if any(zlib.crc32(out[k * cm.BLOCK : (k + 1) * cm.BLOCK].tobytes()) != s for k, s in enumerate(self.sums.tolist())):
            raise ValueError("a block of a token segment is damaged")
        return out


def decoded(raws) -> list[tuple[Segment, np.ndarray]]:
    """Segments with their ids; the blocks of all are decoded in step."""
    found = [Segment(r) for r in raws]
    return [(s, s.checked(x)) for s, x in zip(found, cm.decode([(s.prior, s.codes, s.n) for s in found]), strict=True)]


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer_file: str = "byte_bpe_50k.json", end_id: int = END_ID, segment: int = SEGMENT, together: int = TOGETHER) -> None:
    """Writes the ids of all documents, each closed by end_id, in ascending doc_id order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # rows of one doc_id may be many
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches):
        from pyspark import TaskContext

        if tokenizer(tokenizer_file).get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 65,536")
        encoder, part = piece_encoder(tokenizer_file), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u2").tobytes()
        names, ids, size, ready, waiting, number, before = [], [], 0, [], 0, 0, 0

        def write():
            nonlocal number, before, ready, waiting
            made = cm.encode([meta["flat"] for meta in ready])
            out = [(part, number + k, before, len(meta["flat"]), image(meta, prior, codes)) for k, (meta, (prior, codes)) in enumerate(zip(ready, made, strict=True))]
            starts = np.cumsum([0, *(x[3] for x in out)])
            out = [(p, s, before + int(b), n, raw) for (p, s, _, n, raw), b in zip(out, starts)]
            number, before, ready, waiting = number + len(out), before + int(starts[-1]), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "segment", "before", "n_tokens", "image"])

        for b in sliced(batches, ROWS):
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            for some in portions(texts, ROWS, CHARS):
                for d, x in zip(doc_ids[at : at + len(some)], encoder(some), strict=True):
                    names.append(d)
                    ids.append(x + end)
                    size += len(x) // 2 + 1
                    if size >= segment:
                        ready.append(pack(names, ids))
                        waiting += size
                        names, ids, size = [], [], 0
                at += len(some)
                if waiting >= together:
                    yield write()
        if names:
            ready.append(pack(names, ids))
        if ready:
            yield write()

    ordered.mapInArrow(lean(run), "part int, segment int, before long, n_tokens long, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, together: int = TOGETHER) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    files = spark.read.parquet(path)
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number a partition
    ahead, so_far = {}, 0
    for p in sorted(totals):
        ahead[p] = so_far
        so_far += totals[p]

    def run(batches):
        for b in batches:
            part, before, raws, n = (b.column(k).to_pylist() for k in range(4))
            i = 0
            while i < len(raws):
                j, size = i, 0
                while j < len(raws) and (j == i or size + n[j] <= together):
                    size += n[j]
                    j += 1
                for k, (s, ids) in zip(range(i, j), decoded(raws[i:j])):
                    starts = np.concatenate([[0], np.cumsum(s.sizes, dtype=np.int64)])
                    own = [ids[x:y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())]
                    columns = [
                        pa.array(s.ids, pa.int64(), mask=s.null.astype(bool)),
                        pa.array(starts[:-1] + before[k] + ahead[part[k]]),
                        pa.array(s.sizes.astype(np.int64)),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("part", "before", "image", "n_tokens").mapInArrow(lean(run), schema)


def token_output(docs: DataFrame) -> DataFrame:
    """Writes docs' ids into a new folder in the shared one and reads them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)
