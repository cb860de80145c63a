"""Document fingerprints as improbable-feature digests (operator 1).

Every window of WINDOW bytes gets its Shannon entropy. Windows are ranked by how rare their entropy is: far from that of ordinary
text is rare, while near-constant and near-random windows say nothing and come last. Windows of equal rank are ordered by a hash
of their bytes, then by place. In each stretch of STRETCH windows (of all, if there are fewer) the best one gets a vote, and windows
with VOTES votes are features. Where a run of stretches has no feature (as in a text of one letter, where the vote moves on with
each stretch), the best window of the run is one, so that every text that is not empty has some. A feature's hash sets HASHES bits
of a Bloom filter of BITS bits; after FULL features the next filter of the chain begins. Digests are compared filter by filter:
the common bits, less those expected by chance, over the most that were possible; each filter takes its best
partner, weighted by features, and the two directions are averaged.

Nulls and ties: a null text is empty; an empty text has an empty digest (likeness 1 to another empty one, 0 to the rest). A
text shorter than a window is one feature. Equal texts have equal digests. In the order of ids (integers, or texts, as which others
are read), repeated ids are ordered by a hash of their text, and null ids stand last. A table of one row is its own next row. Long
texts are ranked and compared in blocks. No rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

WINDOW, STRETCH, VOTES = 16, 16, 4
BITS, HASHES, FULL = 2048, 5, 160
#: Bytes whose windows are ranked at once, and filters of a chain that are filled at once.
BLOCK, CHAIN = 1 << 17, 1024
#: Bits of a window's place among those ranked at once (over BLOCK and the stretches around it), and of the hash above it.
PLACE, TIE = 18, 36
#: Rows of adjacent keys that make a part, while there are fewer than MOST_PARTS.
PART_ROWS, MOST_PARTS = 256, 200_000
#: Keys that are sampled for each part to place the cuts.
SAMPLED = 16
SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_COUNT = np.arange(WINDOW + 1)
#: n * log2(n) in fixed point, so that sums are exact and equal windows have equal entropy.
_LOG = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * (1 << 16)).astype(np.int64)
_STEP = np.diff(_LOG)
#: Entropy in 1/16 bits of windows of ordinary text; rarity grows with the distance from it, up to where windows say nothing.
_LEVELS = 16 * int(np.log2(WINDOW)) + 1
_USUAL, _LEAST, _MOST = 52, 12, 65


def _ranks() -> np.ndarray:
    """Rank of each entropy level; a low one is improbable and informative."""
    level = np.arange(_LEVELS)
    rank = _LEVELS - np.abs(level - _USUAL)
    return np.where((level < _LEAST) | (level >= _MOST), 4 * _LEVELS, rank).astype(np.int64)


RANKS = _ranks()
#: Above every key of a window: rank, hash, place.
_LAST = np.iinfo(np.int64).max


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """Entropy level (1/16 bits) of every window of the bytes x; none if x is shorter.

    A window's entropy follows from the one before by the counts of the byte that enters and of the one that leaves. Both counts
    come from comparing x with itself, shifted by each distance within a window.
    """
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = np.bincount(x[:WINDOW], minlength=1)
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _LOG[first].sum()
    # the byte that leaves goes first: it has `after` equals left in the old window; the one that enters meets `before` equals
    total[1:] = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    np.cumsum(total, out=total)
    bits = (_LOG[WINDOW] - total) * 16 // (WINDOW << 16)
    return np.clip(bits, 0, _LEVELS - 1)


def _mix(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


def _orders(x: np.ndarray) -> np.ndarray:
    """Order of every window of the bytes x: its rank, then a hash of its bytes."""
    levels = entropy_levels(x)
    words = np.ndarray((len(levels), WINDOW // 8), np.uint64, buffer=x, strides=(1, 8)) if len(levels) else np.zeros((0, 1), np.uint64)
    return RANKS[levels] << TIE | (_mix(words) >> np.uint64(64 - TIE)).astype(np.int64)


#: A run of windows without a feature before the first one: where it begins, its best order, and where that is.
_NO_RUN = (0, _LAST >> PLACE, 0)


def _select(orders: np.ndarray, first: int, windows: int, at: int, end: int, run: tuple[int, int, int] = _NO_RUN) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Features among windows at to end of a text, and the run that is open at the end; orders are those of windows from ``first``,
    as far as votes reach. ``run`` is the one that is open at the beginning: its best window may be a feature, too."""
    stretch, end = min(STRETCH, windows), min(end, windows)
    keys = orders << PLACE | np.arange(len(orders))
    best, width = keys, 1
    while 2 * width <= stretch:
        best, width = np.minimum(best[:-width], best[width:]), 2 * width
    if width < stretch:
        best = np.minimum(best[: width - stretch], best[stretch - width :])
    votes = np.bincount(best & ((1 << PLACE) - 1), minlength=len(orders))
    pick = np.flatnonzero(votes >= VOTES)
    pick = pick[(pick >= at - first) & (pick < end - first)]
    # the best window before each feature and after the last one
    keys[pick] = _LAST
    begin = np.r_[at - first, pick + 1]
    low = np.minimum.reduceat(np.append(keys[: end - first], _LAST), begin)
    begin, order, place = begin + first, low >> PLACE, (low & ((1 << PLACE) - 1)) + first
    begin[0] = run[0]
    if run[1] <= order[0]:
        order[0], place[0] = run[1:]
    empty = np.r_[pick + first, end] - begin >= stretch
    empty[-1] &= end == windows
    return np.sort(np.concatenate([pick + first, place[empty]])), (int(begin[-1]), int(order[-1]), int(place[-1]))


def _hash_windows(x: np.ndarray, pick: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW)
    return np.concatenate([_mix(np.ascontiguousarray(view[pick[i : i + 4096]]).view(np.uint64)) for i in range(0, max(1, len(pick)), 4096)])


def feature_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """Hashes of the selected windows of each text, in order. Short texts are ranked together, long ones in blocks."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(raws)
    held: list[int] = []

    def together() -> None:
        x = np.frombuffer(b"".join(raws[i] for i in held), np.uint8)
        orders, at, picks = _orders(x), 0, []
        for i in held:
            windows = len(raws[i]) - WINDOW + 1
            picks.append(_select(orders[at : at + windows], 0, windows, 0, windows)[0] + at)
            at += len(raws[i])
        hashes = _hash_windows(x, np.concatenate(picks))
        for i, part in zip(held, np.split(hashes, np.cumsum([len(p) for p in picks])[:-1]), strict=True):
            out[i] = part
        held.clear()

    size = 0
    for i, raw in enumerate(raws):
        if len(raw) < WINDOW:
            if raw:
                out[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
        elif len(raw) > BLOCK:
            x, windows, picks, run = np.frombuffer(raw, np.uint8), len(raw) - WINDOW + 1, [], _NO_RUN
            for at in range(0, windows, BLOCK):
                # votes for a block's windows come from stretches that begin up to STRETCH - 1 before it
                a, b = max(0, at - STRETCH + 1), min(windows, at + BLOCK + STRETCH - 1)
                pick, run = _select(_orders(x[a : b + WINDOW - 1]), a, windows, at, at + BLOCK, run)
                picks.append(pick)
            out[i] = _hash_windows(x, np.concatenate(picks))
        else:
            if held and size + len(raw) > BLOCK:
                together()
                size = 0
            held.append(i)
            size += len(raw)
    if held:
        together()
    return out


class Digest:
    """Chained filters and the features in each."""

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // FULL)
        self.counts = np.full(n, FULL)
        if n:
            self.counts[-1] = len(hashes) - FULL * (n - 1)
        self.filters = np.empty((n, BITS // 8), np.uint8)
        for at in range(0, n, CHAIN):
            part = hashes[at * FULL : (at + CHAIN) * FULL]
            bits, chain = np.zeros((-(-len(part) // FULL), BITS), bool), np.arange(len(part)) // FULL
            for k in range(HASHES):
                bits[chain, (part >> np.uint64(11 * k)) % np.uint64(BITS)] = True
            self.filters[at : at + CHAIN] = np.packbits(bits, axis=1)
        self.ones = np.bitwise_count(self.filters).sum(axis=1).astype(float)

    def __str__(self) -> str:
        """Features, a colon, the filters as hex."""
        return f"{self.counts.sum()}:{self.filters.tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        out, (n, filters) = cls(np.zeros(0, np.uint64)), text.split(":")
        out.filters = np.frombuffer(bytes.fromhex(filters), np.uint8).reshape(-1, BITS // 8)
        out.ones = np.bitwise_count(out.filters).sum(axis=1).astype(float)
        out.counts = np.full(len(out.filters), FULL)
        if len(out.filters):
            out.counts[-1] = int(n) - FULL * (len(out.filters) - 1)
        return out


def digests(texts: list[str]) -> list[Digest]:
    return [Digest(h) for h in feature_hashes([t.encode() for t in texts])]


def _best(a: Digest, own: np.ndarray, b: Digest, best: np.ndarray) -> np.ndarray:
    """Normalised overlap of each filter ``own`` of a with its best partner in b; best is raised to what those of b find."""
    out, left, right = np.empty(len(own)), a.filters.view(np.uint64), b.filters.view(np.uint64)
    for k, i in enumerate(own):
        common = np.bitwise_count(right & left[i]).sum(axis=1, dtype=np.int64)
        chance = a.ones[i] * b.ones / BITS
        score = np.maximum(0, (common - chance) / np.maximum(1, np.maximum(a.ones[i], b.ones) - chance))
        out[k] = score.max()
        np.maximum(best, score, out=best)
    return out


def likeness(a: Digest, b: Digest) -> float:
    """Normalised bit overlap, 0 to 1; 1 for equal digests.

    Filters that both have are each other's best partners. Every other one is held against all of the other chain, one at a time: memory
    grows with the longer text, time with the product of both (3 s for two unlike texts of 10 MB, 5 minutes for 100 MB).
    """
    if not len(a.filters) or not len(b.filters):
        return float(len(a.filters) == len(b.filters))
    if len(a.filters) == len(b.filters) and np.array_equal(a.filters, b.filters):
        return 1.0
    forth, back = np.zeros(len(a.filters)), np.zeros(len(b.filters))
    whole = [np.ascontiguousarray(d.filters).view(f"V{BITS // 8}").ravel() for d in (a, b)]
    known = set(map(bytes, whole[0])) & set(map(bytes, whole[1]))
    same = [np.fromiter((bytes(f) in known for f in w), bool, len(w)) for w in whole]
    rest = np.flatnonzero(~same[0])
    forth[rest] = _best(a, rest, b, back)
    if len(rest) < len(forth):
        # the filters of b that a has not, against those of a that were not held against them
        forth[same[0]], back[same[1]] = 1, 1
        few = Digest(np.zeros(0, np.uint64))
        few.filters, few.ones = a.filters[same[0]], a.ones[same[0]]
        left = np.flatnonzero(~same[1])
        back[left] = np.maximum(back[left], _best(b, left, few, np.zeros(len(few.filters))))
    return float(min(1.0, ((forth * a.counts).sum() / a.counts.sum() + (back * b.counts).sum() / b.counts.sum()) / 2))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the first as many code points of what follows."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _literal(values: list, kind: str) -> Column:
    """A constant array of any length, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (an integer or a text), text and a hash of it, by which rows of one id are ordered."""
    kind = dict(df.dtypes)[id_col]
    key = F.col(id_col).cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "string")
    return df.select(key.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))


def _sorting(key: tuple) -> tuple:
    """Spark's order of a (doc_id, hash, ..): nulls first."""
    return (key[0] is not None, key[0] if key[0] is not None else 0, *key[1:])


_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _spaced(keys: list, parts: int) -> list:
    """parts - 1 of the sorted keys, evenly spaced."""
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """doc_id, text, hash, part, sub, ghost: all rows in parts of adjacent keys (id, hash of the text), part 0 having the largest. Each
    part also has, as a ghost, the first row of the part that follows; the last part has the first row of all.

    Parts are cut at approximate quantiles of the id; the cuts (a few bytes for each part) go through the driver. An id with more rows
    than a part has parts of its own, cut by the hash. A row that repeats whole more often than that is a part of its own, dealt out
    in subs: each copy is followed by another one, but for the last of sub 0, so that the other subs need no ghost.
    """
    df = _keyed(df, id_col, text_col)
    kind = dict(df.dtypes)["doc_id"]
    # ids alone say where to cut; texts are read only of ids that have more rows than a part
    ids = df.select("doc_id")
    rows = ids.count()
    parts, most = max(1, min(most_parts, rows // part_rows)), max(part_rows, rows // most_parts)
    bound = int(min(1.0, SAMPLED * parts / max(1, rows)) * (1 << 30))

    def sampled(table: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*table.columns[:2], F.lit(11)), F.lit(1 << 30)) < bound

    many = [r["doc_id"] for r in ids.groupBy("doc_id").count().where(F.col("count") > most).collect()]
    found = [r["doc_id"] for r in ids.where(sampled(ids) & F.col("doc_id").isNotNull()).distinct().collect()] if parts > 1 else []
    chosen = {(i, _HIGHEST, 1) for i in _spaced(sorted(set(found).difference(many)), parts)}
    hot, keys = {}, None
    if many:
        listed = F.broadcast(df.sparkSession.createDataFrame([(i,) for i in many], f"many_id {kind}"))
        same = df["doc_id"].eqNullSafe(listed["many_id"])
        keys = df.join(listed, same, "left_semi").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
        held = keys.where(sampled(keys) | (F.col("n") > most)).collect()
        hot = {(r["doc_id"], r["hash"]): -(-r["n"] // most) for r in held if r["n"] > most}
        chosen |= {(*key, 1) for key in _spaced(sorted(((r["doc_id"], r["hash"]) for r in held if r["n"] <= most), key=_sorting), parts)}
        chosen |= {(i, h, side) for i in many for h, side in ((_LOWEST, -1), (_HIGHEST, 1))} | {(*key, side) for key in hot for side in (-1, 1)}
        ids = ids.join(listed, ids["doc_id"].eqNullSafe(listed["many_id"]), "left_anti")
    # a cut stands right after (1) or before (-1) a key; those of other ids stand after all their rows
    cuts = sorted(chosen, key=_sorting)
    shape, place = f"struct<doc_id:{kind},hash:bigint,side:int>", F.struct("doc_id", "hash", F.lit(0).alias("side"))
    as_json = [{"doc_id": a, "hash": b, "side": c} for a, b, c in cuts]
    # two steps of a search: which run of cuts, and how many cuts of that run are below the key
    run = max(1, int(len(cuts) ** 0.5))
    firsts, runs = _literal(as_json[::run], shape), _literal([as_json[i : i + run] for i in range(0, len(cuts), run)], f"array<{shape}>")

    def parted(table: DataFrame) -> DataFrame:
        table = table.withColumn("run", F.size(F.filter(firsts, lambda c: c < place)))
        below = F.when(F.col("run") > 0, (F.col("run") - 1) * run + F.size(F.filter(F.get(runs, F.col("run") - 1), lambda c: c < place)))
        return table.withColumn("part", (F.lit(len(cuts)) - F.coalesce(below, F.lit(0))).cast("int")).drop("run")

    # the largest key of each part; of ids that are not split, the id
    top = {r["part"]: (r["top"], None) for r in parted(ids.withColumn("hash", F.lit(0).cast("long"))).groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    if keys is not None:
        top |= {r["part"]: tuple(r["top"]) for r in parted(keys).groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("top")).collect()}
    held = sorted(top)
    before = {p: held[i - 1] for i, p in enumerate(held)}
    heads = [{"doc_id": top[p][0], "hash": top[p][1]} if p in top else None for p in range(len(cuts) + 1)]
    head = F.get(_literal(heads, f"struct<doc_id:{kind},hash:bigint>"), F.col("part"))
    ahead = F.get(_literal([before.get(p) for p in range(len(cuts) + 1)], "int"), F.col("part"))
    df, sub = parted(df), F.lit(0)
    if hot:
        subs = df.sparkSession.createDataFrame([(*key, n) for key, n in hot.items()], f"hot_id {kind}, hot_hash bigint, subs int")
        df = df.join(F.broadcast(subs), df["doc_id"].eqNullSafe(subs["hot_id"]) & (df["hash"] == subs["hot_hash"]), "left")
        sub = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "subs"), F.lit(0)).cast("int")
    df = df.select("doc_id", "text", "hash", "part", sub.alias("sub"))
    own, ghost = (F.struct(p.alias("part"), s.alias("sub"), F.lit(g).alias("ghost")) for p, s, g in ((F.col("part"), F.col("sub"), False), (ahead, F.lit(0), True)))
    first = (F.col("sub") == 0) & head.isNotNull() & F.col("doc_id").eqNullSafe(head["doc_id"]) & (head["hash"].isNull() | (F.col("hash") == head["hash"]))
    places = F.when(first, F.array(own, ghost)).otherwise(F.array(own))
    return df.select("doc_id", "text", "hash", F.explode(places).alias("x")).select("doc_id", "text", "hash", "x.part", "x.sub", "x.ghost")


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A row's next one follows it by descending id; its edited text takes the next one's beginning. Rows of a part are read in
    order, a few at a time.
    """
    laid = in_order(df, id_col, text_col).repartition("part", "sub")
    laid = laid.sortWithinPartitions("part", "sub", "ghost", F.col("doc_id").desc_nulls_last(), F.col("hash").desc())
    kind = dict(laid.dtypes)["doc_id"]
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = None, None  # the part being read, and its last row: id, text, digest
        rows: list[tuple] = []  # rows that follow it

        def flush() -> pa.RecordBatch:
            nonlocal last
            # the first row of a part has no digest yet
            chain = [(last[0], last[1]), *((i, t) for i, t, _ in rows)]
            edits = [edited(t, after[1]) for (_, t), after in zip(chain, chain[1:], strict=False)]
            fresh = digests([t for _, t, _ in rows] + edits + [last[1]] * (last[2] is None))
            own = [last[2] or fresh[-1], *fresh[: len(rows)]]
            changed = fresh[len(rows) : len(rows) + len(edits)]
            n = len(edits)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in chain[:n]], id_type), pa.array([len(t) for _, t in chain[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits]), pa.array([str(d) for d in own[:n]]),
                    pa.array([str(d) for d in changed]), pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                ],
                names=["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))],
            )
            last = None if rows[-1][2] else (*chain[-1], own[-1])
            rows.clear()
            return out

        def end() -> Iterator[pa.RecordBatch]:
            """The end of a part without a ghost: its last row is followed by a copy."""
            if last is not None:
                if not part[1]:
                    raise ValueError(f"part {part[0]} has no end")
                rows.append((*(rows[-1] if rows else last)[:2], True))
                yield flush()

        held = 0
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "sub", "ghost"))
            for doc_id, text, *at, ghost in zip(*columns, strict=True):
                text = text or ""
                if last is not None and at != part:
                    yield from end()
                if last is None:
                    if not ghost:  # else a repeated row's ghost: the part is over
                        part, last = at, (doc_id, text, None)
                    continue
                rows.append((doc_id, text, ghost))
                held += len(text)
                if ghost or held > BLOCK:
                    yield flush()
                    held = 0
        yield from end()

    return laid.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
