"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

Legal roles are an optional system turn and then user and assistant turns in pairs, or
nothing at all.  Each row is kept, given another role, or deleted, and empty turns may be
inserted; of the cheapest edits those win whose letters (D, I, K, R in the order of the
edited conversation) come first in ASCII order.

The edits of a conversation are a path through a graph without cycles: a node is a row
and a state (nothing yet, after system, after user, after assistant), an edge the edits
at a row, that is at most one insertion before it and what happens to the row itself.
(Two insertions at one place never pay: without them the path is as legal and cheaper, or
a lone system turn is deleted for less.)  An edge weighs one integer: its cost in the high
digits, and below them its letters at the row's own two digits, the second one zero where
nothing is inserted.  Letters of equal beginnings stand at equal places, since an insertion
is always followed by its row's own letter or by the end, so integers compare as (cost,
letters) do, and the least sum from each node to the end decides everything.

Numbers stay short: rows are taken in blocks from the last to the first, and what lies
behind a block enters as the cost and, in the lowest digit, the rank of the letters from
each of its states.  So time and memory are linear in the number of rows, a few bytes a
row, however long a conversation is; its texts are never held: they pass by in order,
after the conversation's letters, into the digest.  (A digest of one text can't be divided, so
a conversation's rows meet in one task, but as a stream.  Repeated rows and first
occurrences are found by aggregations beforehand, not in that task.)

Handling: null roles and texts are one space; a null conv_id is a conversation of its own.
Rows are ordered by turn (nulls first), then role, then the text's SHA-256; equal rows are
repeats of the first.  A role is legal by its initial; one without letters has none and can't be
kept.  Other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, lean, sliced, table

#: Costs (fixed values): another role, deletion, insertion, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters by digit; zero pads.
LETTERS = "\0DIKR"
BLOCK = 128
D, I, K, R = 1, 2, 3, 4
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial; the others have none.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: Costs from which on there is no way.
NONE = 1 << 60


def _edges(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """Of each state the edges (cost, two digits, next state) of a row."""
    out = []
    for state in range(4):
        found = []
        for inserted, at in [(0, state)] + [(INSERT, NEXT[state, x]) for x in "ua" if (state, x) in NEXT]:
            digits = lambda letter: I << 3 | letter if inserted else letter << 3  # noqa: B023, E731
            found.append((inserted + DELETE, digits(D), at))
            if not must_go:
                if (at, initial) in NEXT:
                    found.append((inserted + TRUNCATED * truncated, digits(K), NEXT[at, initial]))
                found += [(inserted + REROLE + TRUNCATED * truncated, digits(R), NEXT[at, x]) for x in "ua" if (at, x) in NEXT]
        out.append(found)
    return out


#: A row's code is what decides its edges: initial (s, u, a or another one), whether it must go, whether it is truncated.
INITIALS = "sua?"
EDGES = [_edges(initial, go, cut_) for initial in INITIALS for go in (False, True) for cut_ in (False, True)]
#: The end's edges: nothing, or an insertion.
_END = [[(0, 0, state)] + [(INSERT, I << 3, NEXT[state, x]) for x in "ua" if (state, x) in NEXT] for state in range(4)]


def code_of(initial: str, must_go: bool, truncated: bool) -> int:
    return (max(0, "sua".find(initial)) if initial and initial in "sua" else 3) << 2 | must_go << 1 | truncated


def _block(edges: list[list[list[tuple[int, int, int]]]], behind: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of each state at a block's begin (cost, letters with the rank behind as last digit), and (letters, state behind).

    behind has cost and rank of each state at its end.
    """
    shift = 6 * len(edges) + 3
    value = [(cost << shift | rank, state) for state, (cost, rank) in enumerate(behind)]
    for i, row in enumerate(reversed(edges)):
        at = 3 + 6 * i
        value = [min(((cost << shift | digits << at) + value[to][0], value[to][1]) for cost, digits, to in choices) for choices in row]
    low = (1 << shift) - 1
    return [(v >> shift, v & low) for v, _ in value], [((v & low) >> 3, end) for v, end in value]


def _ranked(values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Letters replaced by their rank among the states."""
    order = sorted({letters for _, letters in values})
    return [(min(cost, NONE), order.index(letters)) for cost, letters in values]


def best_edits(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and letters of the edits for the rows with these codes."""
    behind = [(0 if state in FINAL else NONE, 0) for state in range(4)]
    values, last = _block([_END], behind)
    chosen = [last]
    for end in range(len(codes), 0, -block):
        values, part = _block([EDGES[c] for c in codes[max(0, end - block) : end]], _ranked(values))
        chosen.append(part)
    cost, state, letters = values[START][0], START, []
    for part in reversed(chosen):
        digits, state = part[state]
        letters.append("".join(LETTERS[int(d)] for d in f"{digits:o}" if d != "0"))  # the digits are octal ones
    return cost, "".join(letters)


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns_of(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log's rows as edits() takes them."""
    return log.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), _name(role).alias("role"), _name(text).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of turns_of() after the damage that the checksum of each one's conversation and turn decides."""
    kind = F.crc32(F.concat(_name("conv_id"), F.lit(":"), _name("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), times.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, repeats, blank, truncated and first of the distinct rows; first: neither role and text nor an equal row came before."""
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    short = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
    each = cut(short.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("repeats")))
    earliest = each.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("e"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return each.join(earliest, same).withColumn("first", F.col("turn").eqNullSafe(F.col("e.turn"))).drop("c", "r", "d", "e")


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FACTS = [pa.int64()] * 6 + [pa.string()]
LEGAL = {"su", "ua", "au"}


class _Walk:
    """One conversation's rows in order, a byte a row."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.before: str | None = None

    def take(self, turn: int | None, role: str, repeats: int, blank: bool, truncated: bool, first: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        initial = role[:1]
        pair = lambda a: a + initial not in LEGAL
        self.illegal += (self.before is not None and pair(self.before)) + (repeats - 1) * pair(initial)
        self.before = initial
        if blank:
            self.blank += repeats
            self.codes += bytes([code_of(initial, True, False)]) * repeats
            return
        again = repeats - first
        self.duplicate += again
        if first:
            self.truncated += truncated
            self.codes.append(code_of(initial, False, truncated))
        self.codes += bytes([code_of(initial, True, False)]) * again

    def facts(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        cost, audit = best_edits(bytes(self.codes))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def edits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id and FACTS of each conversation of ids (conv_id), whose rows are rows (conv_id, turn, role, text)."""
    found = faults(rows)
    marks = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns if c != "conv_id"])
    both = marks.unionByName(found.withColumn("kind", F.lit(1)))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "turn", "role", "repeats", "blank", "truncated", "first")

    def walk(batches):
        ids_type, names = None, ["conv_id", *[x.split()[0] for x in FACTS.split(", ")]]
        now, out = None, []

        def done():
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), [ids_type, *_FACTS], strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for conv, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # each conversation begins with its mark
                    if now is not None:
                        out.append((now[0], *now[1].facts()))
                        if len(out) >= 512:
                            yield done()
                    now = (conv, _Walk())
                else:
                    now[1].take(*row)
        if now is not None:
            out.append((now[0], *now[1].facts()))
        if out:
            yield done()

    kind = found.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(lean(walk), f"conv_id {kind}, {FACTS}")


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of audit, for a conversation's rows (role, text) in order; each row is taken when it is due."""
    size = len(audit) - audit.count("D")
    at = 0
    for letter in audit:
        name = "user" if (at - size % 2) % 2 == 0 else "assistant"  # an odd number begins with the system turn, which is kept
        role, text = (name, "") if letter == "I" else next(rows)
        if letter != "D":
            yield (role if letter == "K" else name), text
            at += 1


def _ordered(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Each conversation's facts and behind them its rows in order, dealt by conversation: conv_id, audit (with the facts only), role, text."""
    own = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(None).cast("string").alias("audit"), "text")
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    heads = facts.select("conv_id", F.lit(0).alias("kind"), none("turn"), none("role"), none("digest"), "audit", none("text"))
    return heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "audit", "role", "text")


def _conversations(batches) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """conv_id, audit and the rows of each conversation as they pass by."""
    rows = (row for batch in sliced(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(rows, None)

    def own():
        nonlocal ahead
        while (ahead := next(rows, None)) is not None and ahead[1] is None:
            yield ahead[2], ahead[3]

    while ahead is not None:
        conv, audit = ahead[:2]
        body = own()
        yield conv, audit, body
        for _ in body:  # what the reader left
            pass


def repaired(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches):
        out, ids = [], None
        size = 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), [ids, pa.int64(), pa.string(), pa.string()], strict=True)], names=["conv_id", "place", "role", "text"])

        def typed(source):
            nonlocal ids
            for batch in source:
                ids = batch.schema.field(0).type
                yield batch

        for conv, audit, body in _conversations(typed(batches)):
            for place, (role, text) in enumerate(repaired_rows(audit, body), 1):
                out.append((conv, place, role, text))
                size += len(text)
                if len(out) >= 512 or size > 1 << 20:
                    yield done()
                    out.clear()
                    size = 0
        if out:
            yield done()

    return _ordered(rows, facts).mapInArrow(lean(walk), f"conv_id {kind}, place long, role string, text string")


def digests(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the digest of the repaired conversation's lines role:text."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches):
        ids, out = None, []

        def typed(source):
            nonlocal ids
            for batch in source:
                ids = batch.schema.field(0).type
                yield batch

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], ids), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])

        for conv, audit, body in _conversations(typed(batches)):
            digest, line = hashlib.sha256(), b""
            for role, text in repaired_rows(audit, body):
                digest.update(line + role.encode() + b":" + text.encode())
                line = b"\n"
            out.append((conv, digest.hexdigest()))
            if len(out) >= 512:
                yield done()
                out.clear()
        if out:
            yield done()

    return _ordered(rows, facts).mapInArrow(lean(walk), f"conv_id {kind}, repaired_sha256 string")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations")
    rows = damaged(turns_of(log))
    facts = cut(edits(rows, log))
    said = digests(rows, facts).withColumnRenamed("conv_id", "c")
    return facts.join(said, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
