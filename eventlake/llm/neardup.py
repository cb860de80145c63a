"""Near-duplicate detection by SimHash fingerprints and a segment-popcount embedding (operator 6).

Fingerprint: A-Z lowered, words ``[^\\x20\\x09-\\x0D]+``, shingles of four words with repeats (fewer words: the whole
sequence; none: fingerprint 0), XXH64 with seed 42; a bit is set where over half of the hashes have it set.

Search: the 64 bits are 32 segments of two, and a fingerprint maps to the vector of its segments' bit counts (0 to 2). The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints. So of two fingerprints within ``2 r`` bits,
with the vector cut in two halves, one half differs by ``r`` at most; with r = 2 some cell of the grid lies within one step
of both. Every distinct fingerprint is entered in the cells within one step of either half (50 on average, 66 at most), cells are joined, and
what meets is verified by the exact distance. No link is lost, and equal fingerprints are entered once.

A cell of many links gives a spanning forest of them, not all pairs (cells of up to 24 members give their pairs). Cells that may hold more than ``hot`` fingerprints are split in
blocks, and each pair of blocks is a group of its own, so that no task gets an unbounded group.

Nulls and ties: a null text has fingerprint 0, as one without words; equal fingerprints are linked. The component's id is its
smallest non-null id (null if it has none). Repeated rows stay in near_duplicates(). No rows: no rows out. Other columns are not read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import slices, spill
from eventlake.llm.components import connected

WORDS = 4
SEED = 42
#: Differing bits of linked fingerprints. The search is built for this number.
BITS = 4
#: Fingerprints in a cell above which it is split in blocks, and those in a block.
HOT, BLOCK = 100_000, 50_000
#: Groups up to SMALL are compared pair by pair, all groups of a batch at once; those up to MIDDLE as a matrix each.
SMALL, MIDDLE = 24, 1024
#: The lower bit of each two-bit segment of a half.
EVEN = 0x55555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(parts) - words + 1)].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=">u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return df.mapInArrow(of, f"doc_id {dict(df.dtypes)['doc_id']}, fp long")


def _embedded(fps: DataFrame) -> DataFrame:
    """Bit counts of two-bit segments, as lanes of two bits; a row for each half: fp, half (0 or 1, at bit 32), lanes."""
    bits = "shiftrightunsigned(fp, {0}) & 4294967295L"
    counts = f"({bits} & {EVEN}L) + (shiftright({bits}, 1) & {EVEN}L)"
    halves = F.array(*(F.struct(F.lit(h << 32).alias("half"), F.expr(counts.format(32 * h)).alias("lanes")) for h in (0, 1)))
    return fps.select("fp", F.explode(halves).alias("x")).select("fp", "x.half", "x.lanes")


#: The cells within one step of a half: the half's own lanes, and one lane more or less by one.
_NEAR = """explode(concat(array(half + lanes),
    transform(filter(sequence(0, 15), i -> (shiftright(lanes, 2 * i) & 3) < 2), i -> half + lanes + shiftleft(1L, 2 * i)),
    transform(filter(sequence(0, 15), i -> (shiftright(lanes, 2 * i) & 3) > 0), i -> half + lanes - shiftleft(1L, 2 * i))))"""


def cells(fps: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(cell, fp): the groups whose members are compared. Cells that may exceed ``hot`` members appear as pairs of blocks.

    A cell holds what stands within one step of it, so it can exceed hot only next to (or at) lanes that hold over hot / 33.
    """
    halves = _embedded(fps)
    entered = halves.select("fp", F.expr(_NEAR).alias("cell"))
    full = spill(halves.groupBy("half", "lanes").count().where(F.col("count") > hot // 33), "lanes")
    near = full.select("count", F.expr(_NEAR).alias("cell")).groupBy("cell").agg(F.sum("count").alias("n"))
    near = near.select("cell", (F.ceil((F.col("n") + hot) / block) + 1).cast("int").alias("blocks"))
    if full.isEmpty():
        return entered
    # the table of split cells has 33 rows at most for hot / 33 fingerprints; Spark broadcasts it if it is small
    joined = entered.join(near, "cell", "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), j -> named_struct('a', least(mine, j), 'b', greatest(mine, j)))")
    lone = F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    joined = joined.withColumn("mine", mine).withColumn("p", F.explode(F.when(F.col("blocks").isNull(), lone).otherwise(pairs)))
    return joined.select("fp", F.when(F.col("p.a") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "p.a", "p.b")).alias("cell"))


def _forest(fp: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join all links of a group; each member is visited once, against those that no tree has yet."""
    left, heads, tails = np.arange(len(fp)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= bits
            hit = left[near]
            if len(hit):
                left = left[~near]
                todo.extend(hit)
                heads.append(np.full(len(hit), fp[x]))
                tails.append(fp[hit])
    return heads, tails


def _group_links(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in sorted whole groups."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    heads, tails = [fp[:0]], [fp[:0]]
    small = np.repeat(size <= SMALL, size)
    for d in range(1, SMALL):
        near = np.flatnonzero(small[:-d] & (cell[d:] == cell[:-d])) if d < len(cell) else first[:0]
        if not len(near):
            break
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= bits]
        heads.append(fp[near])
        tails.append(fp[near + d])
    for at, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        own = fp[at : at + n]
        if n <= MIDDLE:
            i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own) <= bits)
            if len(i) <= 9 * n:  # of each pair twice and each member: so few links need no forest
                heads.append(own[i[i < j]])
                tails.append(own[j[i < j]])
                continue
        a, b = _forest(own, bits)
        heads += a
        tails += b
    return np.concatenate(heads), np.concatenate(tails)


def links(grouped: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): verified links that connect what is linked in each cell. A pair is found in a few cells, so rows repeat."""
    laid = grouped.repartition("cell").sortWithinPartitions("cell")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = [], []
        def flush(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(cell):
                u, v = _group_links(cell, fp, bits)
                for at in range(0, len(u), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part].view(np.int64)) for x in (u, v)], names=["u", "v"])
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if held_cell and cell[0] == cell[-1] == held_cell[-1][-1]:
                held_cell.append(cell)
                held_fp.append(fp)
                continue
            cell, fp = np.concatenate([*held_cell, cell]), np.concatenate([*held_fp, fp])
            whole = int(np.searchsorted(cell, cell[-1], side="left"))
            yield from flush(cell[:whole], fp[:whole])
            held_cell, held_fp = [cell[whole:]], [fp[whole:]]
        if held_cell:
            yield from flush(np.concatenate(held_cell), np.concatenate(held_fp))

    return laid.select("cell", "fp").mapInArrow(verify, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    docs = spill(fingerprints(df, id_col, text_col, words), "fingerprints")
    fps = spill(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected(links(cells(fps)))
    own = spill(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = spill(own.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    component = own.join(least, "root").select("fp", "component_id")
    return docs.join(component, "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """df without all but one document of each component: that with the smallest id (none counts as the largest) and, of those, the
    smallest hash of the text. Of repeated rows one stays, that with the smallest hash of all columns; texts under one id that are
    in different components stand for one each."""
    keys = [F.xxhash64(F.lit(k), id_col, text_col).alias(f"__k{k}") for k in range(2)]  # 128 bits that stand for an id and a text
    keyed = df.select("*", *keys)
    order = (F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    found = near_duplicates(keyed.withColumn("__key", F.struct(*order, "__k0", "__k1")), "__key", text_col, words)
    stay = found.where("doc_id = component_id").select("doc_id.__k0", "doc_id.__k1").distinct()
    kept = keyed.join(stay, ["__k0", "__k1"], "left_semi")
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    first = Window.partitionBy("__k0", "__k1").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in hashed)))
    return kept.withColumn("__first", F.row_number().over(first)).where("__first = 1").select(*(F.col(f"`{c}`") for c in df.columns))
