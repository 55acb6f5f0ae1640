"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to CHUNK characters is encoded whole.  A longer one is encoded in
chunks that overlap.  Two neighbouring chunks are spliced at a byte offset where
both encodings start a new pre-token and which lies far enough from the left
chunk's end that nothing behind the end can have moved it:

* A byte-level BPE merges inside pre-tokens only, and the splitting pattern
  works from left to right and keeps no memory across a pre-token boundary.  So
  from a common boundary on, the right chunk's tokens are those of the text.
* The left chunk starts at a boundary of the text (its own splice), so its
  boundaries are those of the text, but for what the cut at its end can change.
  A boundary depends on at most the run it closes and LOOKAHEAD characters more
  (look-ahead of the pattern, or a special string cut in two).

If the overlap holds no such boundary it is doubled; once it reaches back over
the whole left chunk, the left chunk itself is doubled instead.  Both end at the
text's end at the latest, so the count is always that of the whole text.

Nulls count as empty texts; empty texts have zero tokens.  Repeated rows stay
repeated, other columns are handed through, columns named like the results are
replaced, an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import append, portions, texts

#: Characters of a chunk and of an overlap, before any widening.
CHUNK, OVERLAP = 32_768, 256
#: Characters before the left chunk's end in which no boundary is trusted.
LOOKAHEAD = 16
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The installed public tokenizer of that file name; its path is looked up where the task runs."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def byte_lengths(name: str) -> np.ndarray:
    """Bytes of text that each id stands for (a byte-level token has one character a byte)."""
    tok = tokenizer(name)
    out = np.zeros(tok.get_vocab_size(with_added_tokens=True), dtype=np.int64)
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = len(token)
    return out


class Chunk:
    """One encoded chunk: ids, and for each token that starts a pre-token its index and byte offset."""

    def __init__(self, name: str, text: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        enc = tokenizer(name).encode(text[start:end], add_special_tokens=False)
        self.ids = np.asarray(enc.ids, dtype=np.int64)
        words = np.asarray([-1 if w is None else w for w in enc.word_ids], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(byte_lengths(name)[self.ids])])
        self.n_bytes = int(offsets[-1])
        new = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
        self.at, self.offset = new, offsets[new]

    def token_at(self, offset: int) -> int:
        return int(self.at[np.searchsorted(self.offset, offset)])


def spliced_ids(text: str, name: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yield the ids of the whole text, in pieces that are spliced at common boundaries."""
    n = len(text)
    left, done = Chunk(name, text, 0, min(n, chunk)), 0  # done: the byte offset in left up to which ids were given out
    while left.end < n:
        wide = overlap
        while True:
            start = left.end - wide
            if start <= left.start:  # no boundary in the whole chunk: take twice as much of the text at once
                left = Chunk(name, text, left.start, min(n, left.start + 2 * (left.end - left.start)))
                break
            right = Chunk(name, text, start, min(n, start + wide + chunk))
            shift = len(text[left.start : start].encode("utf-8", "surrogatepass"))
            last = left.n_bytes - len(text[left.end - LOOKAHEAD : left.end].encode("utf-8", "surrogatepass"))
            mine = left.offset[(left.offset >= max(done, shift)) & (left.offset <= last)] - shift
            common = np.intersect1d(mine, right.offset, assume_unique=True)
            if len(common):
                p = int(common[-1])
                yield left.ids[left.token_at(done) if done else 0 : left.token_at(p + shift)]
                left, done = right, p
                break
            wide *= 2
    yield left.ids[left.token_at(done) if done else 0 :]


def counts(items: list[str], name: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text; texts over chunk characters go through spliced_ids."""
    tok, out = tokenizer(name), []
    for part in portions(items):
        short = [x for x in part if len(x) <= chunk]
        sizes = iter([len(e) for e in tok.encode_batch_fast(short, add_special_tokens=False)])
        out += [next(sizes) if len(x) <= chunk else sum(len(i) for i in spliced_ids(x, name, chunk, overlap)) for x in part]
    return out


def count_tokens(docs: DataFrame, text: str = "text", tokenizer_file: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text."""

    def make():
        def work(batch):
            xs = texts(batch, text)
            n = counts(xs, tokenizer_file, chunk, overlap)
            return [[len(x.encode("utf-8")) for x in xs], n, [k > limit for k in n]]

        return work

    return append(docs, RESULT, make)
