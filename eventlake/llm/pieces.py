"""SentencePiece encoding and decoding with sampled segmentations (operator 8).

A text's segmentations are the paths of a lattice of vocabulary pieces; a path's probability is the product of its pieces' weights
(a unigram model's own, else a power of the rank, after Zipf). Forward filtering sums the weights of all paths to each position;
backward sampling walks from the end and takes each arc by its share of that sum, so that paths are drawn exactly by their
probability. The random numbers depend on the row's key, the segment's number in the text and the step alone, so that equal
rows get equal samples in any order and on any machine.

No piece crosses certain borders (a letter and a mark, a word and the space after it), so a text's lattice is a chain of small
ones; each Python worker keeps those of the segments met so far, in a table of bounded size, and all segments of many texts are
sampled together, a step at a time.

Decoding joins the pieces and restores the text exactly: characters without a piece, and U+2581 itself, are written as bytes.

Nulls and ties: a null text gives null ids and decodes to null; an empty text gives no ids. Rows with equal keys and texts get
equal samples; a null key counts as the text "None". Whole texts of any length are read, in time that grows with their length. No
rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

SPACE = "▁"
#: Noncharacters that no piece has: what stands between segments, and in U+2581's place.
BORDER, STAND_IN = "\U0010fffe", "\U0010ffff"
#: Power of a rank (1 is Zipf's law); a higher one samples fewer, larger pieces.
ZIPF = 1.0
SEED = 42
#: Segments, and arcs of their lattices, above which a worker forgets some.
KEPT, ARCS = 150_000, 3_000_000
#: Bytes of text that are segmented at once.
SLICE = 1 << 20
#: Below so many open segments, each is sampled to its end by itself.
FEW = 24


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Table:
    """Pieces by a 64-bit hash of their characters, in a sparse table that numpy probes."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.lengths = {len(p) for p in pieces}
        self.keys, self.values = np.zeros((1 << self.BITS) + 64, np.uint64), np.zeros((1 << self.BITS) + 64, np.int32)
        hashes = [int(self.whole(_codes(p))) for p in pieces]
        if len({*hashes, 0}) <= len(hashes):
            raise ValueError("two pieces share a hash")
        self.probes = 1
        for k, h in enumerate(hashes):
            at = start = int(self._slot(np.uint64(h)))
            while self.keys[at]:
                at += 1
            self.keys[at], self.values[at], self.probes = h, k, max(self.probes, at - start + 1)

    @staticmethod
    def longer(h: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        """Hashes of spans that end in the characters x, from those without them."""
        h = x if h is None else h * np.uint64(0x9E3779B97F4A7C15) + x
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def whole(self, x: np.ndarray) -> np.ndarray:
        h = None
        for c in x:
            h = self.longer(h, np.array([c]))
        return h[0]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, x: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of each piece in the characters x; left is how many of a segment's characters stand after each one."""
        starts, h, found = np.arange(len(x)), None, []
        for n in range(1, max(self.lengths) + 1):
            if n > 1:
                inside = left[starts] >= n - 1
                starts, h = starts[inside], h[inside]
            if not len(starts):
                break
            h = self.longer(h, x[starts + n - 1])
            at = self._slot(h)
            for probe in range(self.probes if n in self.lengths else 0):
                hit = np.flatnonzero(self.keys[at + probe] == h)
                found.append((starts[hit] + n - 1, self.values[at[hit] + probe]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


class Lattices:
    """Filtered lattices of segments. Nodes and arcs are numbered through; an arc leads back to the node that it comes from."""

    def __init__(self, path: str, zipf: float = ZIPF):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        # a BPE model's scores are whole numbers, by which its pieces are in order
        whole = np.all(scores == np.round(scores))
        self.pieces = [model.id_to_piece(i) for i in plain]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so that texts can't be restored")
        if any(BORDER in p or STAND_IN in p for p in self.pieces):
            raise ValueError("a piece holds a noncharacter")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece crosses the border before a space")
        # where no piece holds a letter beside something else, that is a border too
        mixed = re.compile(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]")
        apart = not any(mixed.search(p.lstrip(SPACE)) for p in self.pieces)
        self.split = re.compile(r" *[^\W\d_]+| *(?:(?![^\W\d_])[^ ])+| +" if apart else r" *[^ ]+| +").findall
        self.ids = np.array(plain, np.int32)
        self.log_weight = -zipf * np.log(np.arange(len(plain)) + 2.0) if whole else scores
        self.length = np.array([len(p) for p in self.pieces])
        self.table = _Table(self.pieces)
        self.known: dict[str, int] = {}
        #: The last node of each segment; the first arc of each node; an arc's cumulated share, source and id.
        self.ends, self.first, self.share, self.back, self.piece = map(_Column, (np.int32, np.int32, np.float32, np.int32, np.int32))
        self.marks: list[tuple[int, ...]] = []

    def learn(self, segments: list[str]) -> None:
        """Filter the lattices of new segments, all of them together, a position at a time."""
        columns = (self.ends, self.first, self.share, self.back, self.piece)
        self.marks.append(tuple(c.n for c in columns))
        # U+2581 itself is written as if it had no piece
        flat = BORDER.join(segments).replace(SPACE, STAND_IN).replace(" ", SPACE)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        # a node for each character; first in order, then by place in the segment
        n_nodes, base = int(sizes.sum()), self.first.n
        last = np.cumsum(sizes) - 1
        chars = np.arange(n_nodes) + np.repeat(np.arange(len(segments)), sizes)
        place = np.arange(n_nodes, dtype=np.int32) - np.repeat((last + 1 - sizes).astype(np.int32), sizes)
        node, k = self.table.find(_codes(flat)[chars], np.repeat(sizes, sizes) - 1 - place)
        by_place = np.argsort(place.astype(np.int16) if place.max() < 1 << 15 else place, kind="stable")
        rank = np.empty(n_nodes + 1, np.int64)
        rank[by_place], rank[-1] = np.arange(n_nodes), -1
        n_chars = self.length[k]
        # the order of a node's arcs is fixed by their lengths, so that samples don't hang on what was learnt beside
        order = np.argsort(rank[node] * 64 + n_chars)
        node, k, n_chars = node[order], k[order], n_chars[order]
        source = rank[np.where(n_chars <= place[node], node - n_chars, -1)]
        back, ids, weight, node = source.copy(), self.ids[k], self.log_weight[k], rank[node]
        # characters without a piece of their own: a chain of bytes, whose last arc stands last at the character's node
        alone = np.ones(n_nodes, bool)
        alone[node[n_chars == 1]] = False
        lone = by_place[np.flatnonzero(alone)]
        chain_node, chain_back, chain_id, at, more = [], [], [], [], []
        n_all = n_nodes
        for x in lone.tolist():
            c = flat[chars[x]]
            before = int(rank[x - 1]) if place[x] else -1
            if c == STAND_IN and segments[int(np.searchsorted(last, x))] == SPACE:
                c = SPACE
            *lead, final = c.encode()
            through = before
            for byte in lead:
                chain_node.append(n_all)
                chain_back.append(through)
                chain_id.append(self.bytes[byte])
                through, n_all = n_all, n_all + 1
            at.append(int(rank[x]))
            more.append((before, through, self.bytes[final]))
        if more:
            where = np.searchsorted(node, at, side="right")
            extra = np.array(more)
            node, source, back = np.insert(node, where, at), np.insert(source, where, extra[:, 0]), np.insert(back, where, extra[:, 1])
            ids, weight = np.insert(ids, where, extra[:, 2].astype(ids.dtype)), np.insert(weight, where, self.log_weight.min())
        head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        tail = np.r_[head[1:], len(node)]
        total = np.zeros(n_nodes + 1)  # log of the sum to each node; the last stands for the beginning
        share = np.empty(len(node))
        for n0, n1 in _runs(place[by_place]):
            a, b = head[n0], tail[n1 - 1]
            first, here = head[n0:n1] - a, node[a:b] - n0
            value = total[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, first)
            part = np.exp(value - top[here])
            summed = np.add.reduceat(part, first)
            total[n0:n1] = top + np.log(summed)
            part /= summed[here]
            run = np.cumsum(part)
            share[a:b] = run - (run[first] - part[first])[here]
        share[tail - 1] = 2.0  # rounding never leads past the last arc
        n_arcs = self.share.n
        self.first.add(np.r_[head, len(node) + np.arange(len(chain_node))] + n_arcs)
        self.share.add(np.r_[share, np.full(len(chain_node), 2.0)])
        back = np.r_[back, np.array(chain_back, np.int64)]
        self.back.add(np.where(back >= 0, back + base, -1))
        self.piece.add(np.r_[ids, np.array(chain_id, ids.dtype)])
        self.known.update(zip(segments, range(self.ends.n, self.ends.n + len(segments)), strict=True))
        self.ends.add(rank[last] + base)

    def forget(self) -> None:
        """Keep the segments learnt first, so the commonest: about half of what may be kept."""
        at = next((m for m in self.marks if m[0] > KEPT // 2), self.marks[-1] if self.marks else None)
        if at is not None:
            for c, n in zip((self.ends, self.first, self.share, self.back, self.piece), at, strict=True):
                c.n = n
            self.marks = [m for m in self.marks if m[0] < at[0]]
            self.known = {s: i for s, i in self.known.items() if i < at[0]}

    def segments(self, text: str) -> list[str]:
        """The text with a space before it, cut at borders. U+2581 stands alone and is written as bytes."""
        out = []
        for i, part in enumerate((" " + text).split(SPACE)):
            if i:
                out.append(SPACE)
            out += self.split(part)
        return out

    def sample(self, texts: list[str], keys: list[str], seed: int = SEED) -> list[np.ndarray]:
        """Ids of a segmentation of each text."""
        if self.ends.n > KEPT or self.share.n > ARCS:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut])
        flat = list(chain.from_iterable(cut))
        which = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(which < 0)
        if len(new):
            met = [flat[i] for i in new.tolist()]
            self.learn(list(set(met)))
            which[new] = np.fromiter(map(self.known.__getitem__, met), np.int64, len(met))
        row = np.repeat(np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in keys], np.uint64), sizes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(which), dtype=np.uint64) - np.repeat(begin, sizes).astype(np.uint64)
        ids, counts = self._walk(which, _mix(row + place * np.uint64(0x9E3779B97F4A7C15)))
        per_text = np.zeros(len(texts), np.int64)
        if len(which):
            np.add.at(per_text, np.repeat(np.arange(len(texts)), sizes), counts)
        return np.split(ids, np.cumsum(per_text)[:-1])

    def _walk(self, which: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after another, and how many each has."""
        first, share, back, piece = (c.all() for c in (self.first, self.share, self.back, self.piece))
        node = self.ends.all()[which]
        open_, taken, step = np.arange(len(which)), [], 0
        counts = np.zeros(len(which), np.int64)
        while len(open_) >= FEW:
            u = _unit(_mix(random[open_] + np.uint64(step)))
            arc = first[node]
            late = np.flatnonzero(share[arc] <= u)
            while len(late):
                arc[late] += 1
                late = late[share[arc[late]] <= u[late]]
            taken.append((open_, arc))
            counts[open_] += 1
            node, step = back[arc], step + 1
            left = node >= 0
            open_, node = open_[left], node[left]
        tails = []
        for x, at in zip(open_.tolist(), node.tolist(), strict=True):
            path, k = [], step
            while at >= 0:
                u = float(_unit(_mix(random[x : x + 1] + np.uint64(k)))[0])
                a = int(first[at])
                while share[a] <= u:
                    a += 1
                path.append(a)
                at, k = int(back[a]), k + 1
            tails.append((x, path))
            counts[x] += len(path)
        end = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int64)
        for k, (x, arc) in enumerate(taken):
            out[end[x] - 1 - k] = arc
        for x, path in tails:
            out[end[x] - counts[x] : end[x] - step] = path[::-1]
        return piece[out], counts


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values."""
    cuts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_lattices: dict[tuple, Lattices] = {}


def piece_bytes(path: str) -> list[bytes]:
    """What each id stands for in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece.replace(SPACE, " ").encode())
    return out


class Pieces:
    """Bytes of the pieces, laid out so that numpy joins them."""

    def __init__(self, path: str):
        raw = piece_bytes(path)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and where those of each id end."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        return self.bytes[at].tobytes(), ends

    def texts(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each row's ids, exactly as it was encoded."""
        raw, ends = self.join(ids.flatten().to_numpy(zero_copy_only=False))
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]]
        valid = ids.is_valid().to_pylist()
        return [raw[a + 1 : b].decode() if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), valid, strict=True)]


def lattices(path: str, zipf: float = ZIPF) -> Lattices:
    """A worker's table, kept from task to task."""
    if (path, zipf) not in _lattices:
        _lattices[path, zipf] = Lattices(path, zipf)
    return _lattices[path, zipf]


def encode(df: DataFrame, model: str, seed: int = SEED, zipf: float = ZIPF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (a sampled segmentation) of every row."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattices(model, zipf)
        for batch in slices(batches, limit=SLICE):
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            ids = known.sample([t or "" for t in texts], [str(k) for k in keys], seed)
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32(), mask=np.r_[[t is None for t in texts], False])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and decoded (the text) of every row."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = known.texts(part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, ids array<int>, decoded string")
