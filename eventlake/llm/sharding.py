"""Sharding over fixed virtual slots (operator 10).

Every record (an id with its text) hashes into one of ``n_slots`` virtual slots, whose number never changes. Bytes are summed per
slot, and a stored, versioned map says which shard holds each slot. The first run makes version 1; later ones take the last version,
so that new data joins the old layout. grow() and rebalance() edit the map and store the next version: slots move,
records never rehash. The map has n_slots rows whatever the input, so that it may be collected and broadcast. One job at a time
edits a map.

Law: ``bytes``. Shards get nearly equal bytes, as slots are dealt largest first to the lightest shard.

Nulls and ties: a null text has no bytes (size 16, crc32 0); a null id hashes by its text's checksum; rows repeated whole share a
slot of the map and get places of their own. A slot of many rows is numbered in several tasks. No rows: no rows out, and a map
whose slots are dealt round robin. Other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.common import spill, work_dir
from eventlake.session import complete

LAW = "bytes"
SLOTS = 8192
OVERHEAD = 16
#: Rows of a slot that are numbered in one task, at least; more where all slots are larger.
CHUNK = 1 << 16


def records(df: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (bytes of text plus 16), checksum of the text, virtual slot, and a number that spreads rows repeated whole (it
    follows how the input is split, so that what needs it twice reads it from a written table)."""
    text = F.col(text_col)
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")
    out = df.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    out = out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))
    return out.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))


def slot_sizes(rows: DataFrame, n_slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every virtual slot; n_slots entries."""
    out = [(0, 0)] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        out[r["vslot"]] = (r["b"], r["n"])
    return out


def first_map(sizes: list[tuple[int, int]], n_shards: int) -> list[int]:
    """Slot to shard: the largest slots first, each to the shard with the fewest bytes so far."""
    heap, out = [(0, 0, s) for s in range(n_shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s][0], s)):
        b, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + sizes[slot][0], n + 1, shard))
    return out


def grown_map(mapping: list[int], sizes: list[tuple[int, int]], n_shards: int) -> list[int]:
    """The map after one more shard: shards above the new mean give slots, and only the new shard takes any."""
    out, total = list(mapping), sum(b for b, _ in sizes)
    goal, load = total / (n_shards + 1), [0] * n_shards
    own: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(mapping):
        load[shard] += sizes[slot][0]
        own[shard].append(slot)
    taken = 0
    for shard in sorted(range(n_shards), key=lambda s: (-load[s], s)):
        for slot in sorted(own[shard], key=lambda s: (-sizes[s][0], s)):
            b = sizes[slot][0]
            if b and load[shard] - b >= goal - b / 2 and taken + b <= goal + b / 2:
                out[slot], load[shard], taken = n_shards, load[shard] - b, taken + b
    return out


def rebalanced_map(mapping: list[int], sizes: list[tuple[int, int]], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """The map with few slots moved, from the heaviest shard to the lightest, until none exceeds the mean by more than tolerance (or no
    move makes the heaviest lighter)."""
    out, load = list(mapping), [0] * n_shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(mapping):
        load[shard] += sizes[slot][0]
        own[shard].append((sizes[slot][0], slot))
    limit = (1 + tolerance) * sum(load) / n_shards
    while max(load) > limit:
        a, b = load.index(max(load)), load.index(min(load))
        # the largest slot that leaves the lighter shard below where the heavier one was; half the difference at best
        fit = [x for x in own[a] if 0 < x[0] < load[a] - load[b]]
        if not fit:
            break
        moved = min(fit, key=lambda x: (abs(2 * x[0] - (load[a] - load[b])), x[1]))
        own[a].remove(moved)
        own[b].append(moved)
        out[moved[1]] = b
        load[a], load[b] = load[a] - moved[0], load[b] + moved[0]
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a map that were written whole."""
    return sorted(int(name.partition("=")[2]) for name in complete(spark, path) if name.startswith("version="))


def save_map(spark: SparkSession, path: str, mapping: list[int], sizes: list[tuple[int, int]], n_shards: int) -> int:
    """Store the next version of a map, with the bytes and rows that each slot had then; returns its number."""
    version = max(versions(spark, path), default=0) + 1
    rows = [(slot, shard, *sizes[slot], n_shards) for slot, shard in enumerate(mapping)]
    df = spark.createDataFrame(rows, "vslot int, shard int, bytes long, rows long, shards int")
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")  # what a failed job left of this version goes
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int], int]:
    """Number, slot-to-shard list and number of shards of a version, the last one if not given."""
    found = versions(spark, path)
    if not found or (version or found[-1]) not in found:
        raise ValueError(f"no version {version or ''} of a map in {path}")
    version = version or found[-1]
    rows = sorted(spark.read.parquet(f"{path}/version={version}").select("vslot", "shard", "shards").collect())
    return version, [r["shard"] for r in rows], rows[0]["shards"]


def load_or_create(spark: SparkSession, path: str, n_shards: int, sizes: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The last version of the map, grown to n_shards if it has fewer; version 1 if there is none."""
    if not versions(spark, path):
        mapping = first_map(sizes, n_shards)
        return save_map(spark, path, mapping, sizes, n_shards), mapping
    version, mapping, held = load_map(spark, path)
    if len(mapping) != len(sizes) or held > n_shards:
        raise ValueError(f"the map in {path} has {len(mapping)} slots in {held} shards, not {len(sizes)} in {n_shards}")
    return (version, mapping) if held == n_shards else grow(spark, path, sizes, n_shards - held)


def grow(spark: SparkSession, path: str, sizes: list[tuple[int, int]], more: int = 1) -> tuple[int, list[int]]:
    """Store the map's next version, with more shards; only those take slots."""
    _, mapping, held = load_map(spark, path)
    for n in range(held, held + more):
        mapping = grown_map(mapping, sizes, n)
    return save_map(spark, path, mapping, sizes, held + more), mapping


def rebalance(spark: SparkSession, path: str, sizes: list[tuple[int, int]], tolerance: float = 0.02) -> tuple[int, list[int]]:
    """Store the map's next version, evened out by today's sizes; the last version stands if nothing moves."""
    version, mapping, held = load_map(spark, path)
    moved = rebalanced_map(mapping, sizes, held, tolerance)
    return (version, mapping) if moved == mapping else (save_map(spark, path, moved, sizes, held), moved)


def assign(rows: DataFrame, mapping: list[int], sizes: list[tuple[int, int]], chunk: int = CHUNK) -> DataFrame:
    """Each record of a written table with its shard and its place there, gapless from 0: the rows of earlier slots, those of earlier
    chunks of its slot, then its rank in its chunk. There are 5 / 4 as many chunks as slots at most, so they go through the driver."""
    spark = rows.sparkSession
    chunk = max(chunk, 4 * sum(n for _, n in sizes) // len(sizes))
    chunks = [max(1, -(-n // chunk)) for _, n in sizes]
    split = spark.createDataFrame([(v, n) for v, n in enumerate(chunks) if n > 1], "vslot int, chunks int")
    rows = rows.join(F.broadcast(split), "vslot", "left").withColumn("chunk", F.coalesce(F.pmod("spread", "chunks"), F.lit(0)).cast("int"))
    counts = {(v, 0): n for v, (_, n) in enumerate(sizes)}
    if max(chunks) > 1:
        counts |= {(r["vslot"], r["chunk"]): r["n"] for r in rows.where("chunks > 1").groupBy("vslot", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, places = [0] * (max(mapping, default=0) + 1), []
    for v, c in sorted(counts):
        places.append((v, c, mapping[v], before[mapping[v]]))
        before[mapping[v]] += counts[v, c]
    places = spark.createDataFrame(places, "vslot int, chunk int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("vslot", "chunk").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(places), ["vslot", "chunk"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), "vslot")


def shard_documents(
    df: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard every row by the map at map_path (made if there is none; without a path, a map of this run). next_shard is where a row would
    go with one more shard."""
    spark = df.sparkSession
    rows = spill(records(df, n_slots, id_col, text_col), "shard-records")
    sizes = slot_sizes(rows, n_slots)
    version, now = load_or_create(spark, map_path or f"{work_dir(spark)}/slot-map-{uuid.uuid4().hex}", n_shards, sizes)
    later = spark.createDataFrame(list(enumerate(grown_map(now, sizes, n_shards))), "vslot int, next_shard int")
    out = assign(rows, now, sizes).join(F.broadcast(later), "vslot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "vslot", F.lit(version).alias("map_version"), "next_shard",
    )
