"""Language identification by error-correcting output codes (operator 4).

Every language gets a codeword of bits. For each bit, a binary classifier over hashed byte trigrams (a log ratio of smoothed
frequencies, languages weighing alike) says on which side of the bit a text stands. Decoding takes the codeword with the
least loss, where each bit weighs by how well its classifier separates the languages; a close second flags ambiguity.
Trigram counts come from every training row; they are summed in a table of languages times cells, whose size is bounded: labels
beyond the LANGUAGES commonest ones are not learnt.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0 and not ambiguous. Training leaves out rows
whose text or label is null. Ties go to the first language in order. With no training row everything is ``und``; with one language
all texts with a letter get it. Whole texts of any length are read. No rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

CELLS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: The loss by which the second codeword must exceed the first, as a share of all bits' weight, for a clear decision.
GAP = 0.05
#: Bytes of text that are scored at once, and characters beyond which a text is scored alone, in blocks.
SLICE, LONG = 1 << 20, 1 << 18
#: The most labels that are learnt, those with the most rows: what goes to the driver has LANGUAGES x CELLS numbers at most.
LANGUAGES = 128

LETTER = re.compile(r"[^\W\d_]")
#: Bytes that stay: a-z and those of characters beyond ASCII; the rest become spaces.
KEEP = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    found = LETTER.search(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


def _raw(text: str) -> bytes:
    return b"  " + text.lower().encode().translate(KEEP) + b" "


def _cells(raw: bytes) -> np.ndarray:
    """Cells of the trigrams that begin at each byte but the last two."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


def trigram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of the texts, and where each text's begin; every text has one trigram at least."""
    raw = [_raw(t) for t in texts]
    starts = np.cumsum([0, *(len(r) for r in raw[:-1])])
    return _cells(b"".join([*raw, b"  "])), starts


def cell_blocks(text: str, block: int = LONG) -> Iterator[np.ndarray]:
    """The cells of a long text, some at a time."""
    raw = _raw(text) + b"  "
    for at in range(0, len(raw) - 2, block):
        yield _cells(raw[at : at + block + 2])


BLANK = int(trigram_cells([""])[0][0])


def trigram_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGES) -> dict[str, np.ndarray]:
    """Counts of trigram cells by language, over all rows with a text and one of the ``most`` labels that have the most rows."""
    df = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most).collect()
    learnt = {r["lang"] for r in rows}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=SLICE):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs) & learnt:
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                blocks = cell_blocks(own[0]) if len(own) == 1 and len(own[0]) > LONG else [trigram_cells(own)[0]]
                for found in blocks:
                    held[lang] = held.get(lang, 0) + np.bincount(found, minlength=CELLS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "cell", "n"])

    cells = df.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, np.ndarray] = {}
    lang, cell, n = (cells.column(c).to_numpy() for c in ("lang", "cell", "n"))
    for x in sorted(set(lang)):
        out[x] = np.bincount(cell[lang == x], n[lang == x], minlength=CELLS)
    return out


def code(k: int) -> np.ndarray:
    """Codewords of k languages, k rows of 1 and -1: every split of up to six, else the best of some random matrices."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(splits, dtype=float).T
    rng, best, distance = np.random.default_rng(7), None, -1
    for _ in range(50):
        m = rng.choice((-1.0, 1.0), (k, 15 + 4 * (k - 1).bit_length()))
        m = m[:, np.abs(m.sum(axis=0)) < k]
        d = min((m[i] != m[j]).sum() for i in range(k) for j in range(i))
        if d > distance:
            best, distance = m, d
    return best


class Codewords:
    """The languages, their code, and for each bit a weight for every trigram cell."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = list(counts)
        self.code = code(len(self.langs))
        n = np.stack([*counts.values()]) if counts else np.zeros((0, CELLS))
        p = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * CELLS)
        bits = self.code.T
        self.weights = np.array([np.log(p[b > 0].mean(axis=0) / p[b < 0].mean(axis=0)) for b in bits], np.float32).reshape(len(bits), CELLS)
        self.weights[:, BLANK] = 0
        # how far a bit's classifier puts the worst language on its own side, for a trigram of that language
        self.trust = np.array([max(1e-6, min(b * (p @ w))) for b, w in zip(bits, self.weights, strict=True)])
        self.trust = self.trust / self.trust.sum() if len(bits) else self.trust

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each text."""
        if len(self.langs) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
        n, sums = np.empty(len(texts)), np.empty((len(texts), len(self.weights)))
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            cells, starts = trigram_cells([texts[i] for i in short])
            n[short] = np.diff(np.r_[starts, len(cells)])
            sums[short] = np.stack([np.add.reduceat(w[cells], starts, dtype=np.float64) for w in self.weights], axis=1)
        for i in set(range(len(texts))).difference(short):
            blocks = [(len(c), [w[c].sum(dtype=np.float64) for w in self.weights]) for c in cell_blocks(texts[i])]
            n[i], sums[i] = sum(k for k, _ in blocks), np.sum([x for _, x in blocks], axis=0)
        margins = np.clip(sums / np.sqrt(n)[:, None], -8, 8)
        loss = np.log1p(np.exp(-margins[:, None, :] * self.code[None])) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        sure = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
        rows = np.arange(len(texts))
        return best, 1 / sure.sum(axis=1), loss[rows, order[:, 1]] - loss[rows, best] < GAP


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Codewords:
    return Codewords(trigram_counts(df, text_col, lang_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3 (a null id is held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def identify(df: DataFrame, model: Codewords, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all of df, if not given), lang_pred, score and ambiguous of every row; a prefix keeps these names apart
    from columns of df."""
    keep = df.columns if keep is None else keep
    source = df.select(*keep, F.col(text_col).alias("__text"))
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "ambiguous")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "__text", SLICE):
            texts = batch.column("__text").to_pylist()
            lang, score, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            if known:
                best, score[known], unclear[known] = model.decode([texts[i] for i in known])
                for i, x in zip(known, best, strict=True):
                    lang[i] = model.langs[x]
            found = [pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *found], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    return source.mapInArrow(judge, f"{schema + ', ' if schema else ''}`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
