"""Token counts with public tokenizers, without building the ids of a whole batch.

Both tokenizers used here never let a token cross certain boundaries, so a text is cut there and every distinct chunk is
encoded once by the library: `word_chunks` cuts at ASCII white space (the word vocabulary drops white space), and
`space_parts` at a single space between two other characters (the byte vocabulary puts that space in front of the
word). What the library gives for the chunks, in order, is what it gives for the text. Encoded chunks are kept in a
bounded memory of the Python worker. Batches are balanced by bytes: Arrow delivers at most common.BATCH_BYTES at once (a longer
text alone), and these are cut again to BLOCK_BYTES before the library sees them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries that a worker remembers in each of two generations, the longest chunk it remembers, and bytes of text that are worked on at once.
KEEP_CHUNKS, KEEP_BYTES, BLOCK_BYTES = 400_000, 80, 1 << 20
#: White space as the tokenizers' patterns have it (Unicode White_Space) and the few other characters that Python counts.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}
_counts: dict[str, Memory] = {}


class Memory:
    """What chunks are encoded as, in two generations: a full one becomes the old one, from which what is used again comes back."""

    def __init__(self) -> None:
        self.known: dict = {}
        self.old: dict = {}

    def missing(self, chunks: list[list]) -> list:
        """The distinct chunks that are not known, after those of the old generation are."""
        new = set().union(*chunks).difference(self.known)
        if self.old:
            back = [c for c in new if c in self.old]
            self.known.update((c, self.old[c]) for c in back)
            new.difference_update(back)
        return list(new)

    def settle(self, new: list) -> None:
        for c in new:
            if len(c) > KEEP_BYTES:
                del self.known[c]
        if len(self.known) > KEEP_CHUNKS:
            self.known, self.old = {}, self.known


def library(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def word_chunks(text: bytes) -> list[bytes]:
    return text.split()


def space_parts(text: str) -> list[str]:
    """The text cut at its single spaces between other characters. All parts but the first and last begin and end with such."""
    odd = "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (" " + c in text or c + " " in text) for c in SPACES)
    return SINGLE_SPACE.split(text) if odd else text.split(" ")


def blocks(texts: list, size: int = BLOCK_BYTES) -> Iterator[list]:
    """Runs of texts of at most `size` bytes together, a longer text alone."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > size:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def counts(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each text (UTF-8), as the library counts them for the whole text."""
    memory, out = _counts.setdefault(path, Memory()), []
    for run in blocks(texts):
        words = [word_chunks(t) for t in run]
        new = memory.missing(words)
        found = library(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        memory.known.update(zip(new, map(len, found)))
        out += [sum(map(memory.known.__getitem__, w)) for w in words]
        memory.settle(new)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text); other columns are ignored.

    A null text counts as empty (0 bytes, 0 tokens), a null doc_id stays null, repeated rows each get their row.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column(1)]
            n = counts(texts, path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
