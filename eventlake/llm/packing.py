"""Packing by power-of-two decomposition (operator 9).

A document of n tokens is cut into full sequences of ``width`` tokens and, for the rest, one piece for each bit of n mod width.
Every piece is a sequence of its own: its length is a power of two, so it needs no padding, and no sequence crosses
documents. Sequences of one length share a bucket, and ids count buckets from the longest, gapless.

Token ids are exactly those of the tokenizer. It encodes every word of a text alone, so that the ids of a text are those of its
words in order; each Python worker keeps the ids of words in a bounded table.

Nulls and ties: a null text is empty; an empty text is one piece that holds the end id alone. Repeated rows are packed each, and
numbered in many tasks, as salts are dealt out in turn.
A text of any length is cut the same way. No rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import kept, slices, spill

WIDTH = 2048
END_ID = 1
#: Salts of a bucket; a group of (bucket, salt) is numbered in one task.
SALTS = 1024
#: Token runs kept by a worker, and bytes of text whose new runs are learnt at once.
WORDS, SLICE = 400_000, 4 << 20


#: Letters and digits below U+0250 in lower case, and white space; what is none of these makes runs.
_L, _N, _S = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \t-\r\u0085\u00a0"


class Words(dict):
    """Token run to its ids, as little-endian unsigned 32-bit numbers.

    The tokenizer lowers case, drops white space and splits a text in contractions, runs of letters, single digits and runs of
    anything else, and encodes each alone. Texts whose characters are below U+0250, also in lower case, are split so here. In others
    each word between ASCII white space stands for itself, if it has a higher character or the mark of a special token.
    """

    split = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_L}{_N}{_S}]+")
    beyond = re.compile("[\u0130\u0250-\U0010ffff]|<\\|")
    blank = re.compile(r"[ \t-\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def odd(self, text: str, low: str) -> bool:
        """Whether a text, or its lower case, has a character that only the tokenizer can place."""
        if text.isascii():
            return "<|" in text
        return bool(self.beyond.search(text) or self.beyond.search(low))

    def runs(self, text: str) -> list[str]:
        """Texts whose ids in order are those of text."""
        low = text.lower()
        if not self.odd(text, low):
            return self.split.findall(low)
        out = []
        for word in filter(None, self.blank.split(text)):
            low = word.lower()
            out += [word] if self.odd(word, low) else self.split.findall(low)
        return out

    def learn(self, found: set[str]) -> None:
        """Enter runs. Those of letters below U+0250 end in one word-end token each, so they are encoded as one text."""
        plain = []
        for t in found:
            if t.isalpha() and not self.odd(t, t.lower()):
                plain.append(t)
            else:
                self[t] = self.ids(t).tobytes()
        ids = self.ids(" ".join(plain))
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(plain):
            raise ValueError("a run of letters is not one run of tokens")
        raw, start = ids.tobytes(), 0
        for t, end in zip(plain, (4 * at).tolist(), strict=True):
            self[t] = raw[start:end]
            start = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. The runs met first, so the commonest, are kept for later calls."""
        runs = [self.runs(t or "") for t in texts]
        self.learn(set().union(*runs).difference(self))
        out = [b"".join(map(self.__getitem__, r)) for r in runs]
        for t in list(self)[WORDS:] if len(self) > WORDS else ():
            del self[t]
        return out


def words(path: str) -> Words:
    """A worker's table, kept from task to task until the worker goes on to another operator."""
    return kept(("words", path), lambda: Words(path))


def cuts(n: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, the longest first."""
    out = [(i, width) for i in range(0, n - width + 1, width)]
    at, rest = n - n % width, n % width
    for bit in range(width.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(df: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, salt (in turn, whatever the row holds), and its ids if
    with_ids. Salts follow how the input is split, so that what needs them twice reads them from a written table."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ending = words(tokenizer), np.array([end_id], "<u4").tobytes()
        turn = TaskContext.get().partitionId()
        for batch in slices(batches, limit=SLICE, keep=known):
            rows, start, length, crc, total, held = [], [], [], [], [], []
            for row, ids in enumerate(known.encode(batch.column("text").to_pylist())):
                ids += ending
                raw, n_ids = memoryview(ids), len(ids) // 4
                for s, n in cuts(n_ids, width):
                    rows.append(row)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    total.append(n_ids)
                    if with_ids:
                        held.append(np.frombuffer(raw[4 * s : 4 * (s + n)], "<u4"))
            numbers = [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            salt = pa.array((turn + np.arange(len(rows))) % SALTS, pa.int32())
            turn += len(rows)
            ids = [pa.array(held, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *numbers, salt, *ids], names=[*"doc_id start length ids_crc32 doc_tokens salt".split(), *["ids"] * with_ids])

    schema = f"doc_id {dict(df.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, salt int" + ", ids array<int>" * with_ids
    return df.mapInArrow(cut, schema)


def number(found: DataFrame) -> DataFrame:
    """sequence_id (buckets from the longest, gapless from 0) and offset of each piece of a written table.

    Groups of (length, salt) are counted; there are at most SALTS times log2(width) + 1 of them, so their first ids are
    summed up in one small window and broadcast.
    """
    counts = found.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("length").desc(), "salt")
    first = counts.select("length", "salt", (F.sum("n").over(order) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    placed = found.withColumn("rank", rank.cast("long")).join(F.broadcast(first), ["length", "salt"])
    return placed.withColumn("sequence_id", F.col("first") + F.col("rank") - 1).withColumn("offset", F.lit(0).cast("long"))


def pack(df: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with the sequence and the offset that hold them."""
    found = spill(pieces(df, tokenizer, width, end_id, id_col, text_col), "pieces")
    return number(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
