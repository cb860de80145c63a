"""URL filter (operator 5): rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path (``net/es/``) and a verdict; it fits its host and all subdomains. The longest
fitting rule decides. URLs that a rule decides are the labelled ones: a bounded sample of them trains the trees, which judge
the URLs that no rule fits. The statistics of a host's suffix and of a path's first segment are the shares of blocked ones among all
labelled URLs, less the mean and shrunk towards it, so that a suffix that no rule decides says nothing: 0, which the trees meet in
training, too. There the statistics leave out the row's own fold of hosts.

Nulls and ties: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees as an
empty text. Equal URLs get equal verdicts. Of two fitting rules of one length, block wins. With no labelled URL, or labels of one
kind only, the trees are a constant (allow where there is none). No rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: The most labelled URLs that the trees are fitted on, picked by a hash of the row.
SAMPLE = 20_000
#: Suffixes of hosts and first segments of paths are counted in so many hashed cells, so that the statistics have a fixed size.
CELLS = 4096
#: Folds of hosts, and the weight of the mean in a cell's rate, in URLs.
FOLDS, SHRINK = 5, 20.0
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "length", "host_length", "path_length", "depth", "host_labels", "digits", "digit_ratio", "entropy", "host_entropy", "params", "query_length",
    "host_hyphens", "path_hyphens", "escapes", "is_https", "has_fragment", "last_segment", "first_segment", "suffix_length", "suffix_rate", "segment_rate",
)


def host_and_path(url) -> tuple:
    """Columns of the host (after the first ``://`` up to / ? # or the end, A-Z lowered) and the path after it."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: Sequence[tuple[str, str]] = RULES):
    """The longest rule that fits, as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict of every row."""
    df = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    df = df.select("page_id", F.col("__url").alias("url"), host.alias("host"), path.alias("path"))
    df = df.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return df.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def cell_of(text: str) -> int:
    return zlib.crc32(text.encode()) % CELLS


def rates_of(n: np.ndarray, blocked: np.ndarray, mean: float) -> np.ndarray:
    """How far the share of blocked ones, shrunk towards the mean of all, is from that mean; 0 for a cell without a label."""
    return (blocked - mean * n) / (n + SHRINK)


class Rates:
    """Labels of the URLs that a rule decides, by fold of hosts and cell, for the host's suffix and the path's first segment."""

    def __init__(self):
        self.n, self.blocked = np.zeros((2, 2, FOLDS, CELLS))

    def without(self, fold: int | None = None) -> np.ndarray:
        """Rates of both kinds by cell, leaving out a fold of hosts; two rows of CELLS numbers."""
        rest = [f for f in range(FOLDS) if f != fold]
        n, blocked = self.n[:, rest].sum(axis=1), self.blocked[:, rest].sum(axis=1)
        mean = blocked[0].sum() / n[0].sum() if n[0].sum() else 0.5
        return np.stack([rates_of(a, b, mean) for a, b in zip(n, blocked, strict=True)])


def with_fold(ruled: DataFrame) -> DataFrame:
    """ruled and the fold of each row's host."""
    return ruled.withColumn("fold", F.pmod(F.xxhash64("host", F.lit(5)), F.lit(FOLDS)).cast("int"))


def label_rates(ruled: DataFrame) -> Rates:
    """Statistics over all labelled rows; 2 * FOLDS * CELLS of them at most go to the driver."""
    suffix, segment = F.regexp_extract("host", r"([^.]*)\z", 1), F.regexp_extract("path", "^/?([^/]*)", 1)
    cells = [F.struct(F.lit(i).alias("kind"), F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(CELLS)).cast("int").alias("cell")) for i, c in enumerate((suffix, segment))]
    rows = with_fold(ruled).where("rule is not null").select("fold", (F.col("rule_verdict") == "block").cast("long").alias("y"), F.explode(F.array(*cells)).alias("c"))
    out = Rates()
    for r in rows.groupBy("c.kind", "c.cell", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked")).collect():
        at = (r["kind"], r["fold"], r["cell"])
        out.n[at], out.blocked[at] = r["n"], r["blocked"]
    return out


def entropies(texts: pa.Array) -> np.ndarray:
    """Bits a byte of each text."""
    out = []
    for at in range(0, len(texts), 2048):
        raw = texts[at : at + 2048].cast(pa.binary()).to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        key = np.repeat(np.arange(len(raw)) * 256, sizes) + np.frombuffer(b"".join(raw), np.uint8)
        p = np.bincount(key, minlength=256 * len(raw)).reshape(-1, 256) / np.maximum(1, sizes)[:, None]
        out.append(-(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def _part(texts: pa.Array, pattern: str) -> pa.Array:
    """The group x of a pattern's match in each text, else an empty text."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(texts, "(?s)" + pattern), "x"), "")


def _cells(texts: pa.Array) -> np.ndarray:
    coded = texts.dictionary_encode()
    return np.array([cell_of(t) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(texts) else np.zeros(0, np.int64)


def features(url: pa.Array, host: pa.Array, path: pa.Array, rates: np.ndarray) -> np.ndarray:
    """Lexical features of URLs, a column for each name in FEATURES. Parameters are those between the first ? and a #."""
    query, suffix, segment = _part(url, r"^[^?#]*\?(?P<x>[^#]*)"), _part(host, r"(?P<x>[^.]*)$"), _part(path, "^/?(?P<x>[^/]*)")
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
    length, asked, digits = (number(a) for a in (pc.utf8_length(url), pc.utf8_length(query), pc.count_substring_regex(url, "[0-9]")))
    columns = [
        length, number(pc.utf8_length(host)), number(pc.utf8_length(path)), number(pc.count_substring(path, "/")), number(pc.count_substring(host, ".")) + 1,
        digits, digits / np.maximum(1, length), entropies(url), entropies(host), np.where(asked > 0, number(pc.count_substring(query, "&")) + 1, 0), asked,
        number(pc.count_substring(host, "-")), number(pc.count_substring(path, "-")), number(pc.count_substring(url, "%")), number(pc.starts_with(url, "https:", ignore_case=True)),
        number(pc.match_substring(url, "#")), number(pc.utf8_length(_part(path, r"(?P<x>[^/]*)$"))), number(pc.utf8_length(segment)), number(pc.utf8_length(suffix)),
        rates[0][_cells(suffix)], rates[1][_cells(segment)],
    ]
    return np.stack(columns, axis=1)


class Trees:
    """Gradient-boosted regression trees for logistic loss, grown on quantile bins. Both labels weigh alike, however often each stands."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if len(y) == 0 or y.min() == y.max():
            self.base = -20.0 if len(y) == 0 or y.max() == 0 else 20.0
            return self
        seen = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins))) for c in x.T]
        self.edges = [(u[1:] + u[:-1]) / 2 for u in seen]  # halfway, so that a value between two goes with the nearer one
        binned = self._bin(x)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = self.rate * total_g / (total_h + self.l2)
        best, gain = None, 1e-9
        if depth:
            for f in range(b.shape[1]):
                v = b[rows, f]
                left_g, left_h, left_n = (np.cumsum(np.bincount(v, w, self.bins + 1)) for w in (g[rows], h[rows], None))
                ok = (left_n >= self.least) & (len(rows) - left_n >= self.least)
                gains = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                cut = int(np.argmax(np.where(ok, gains, -1)))
                if ok[cut] and gains[cut] > gain:
                    best, gain = (f, cut), gains[cut]
        if best is None:
            return leaf
        down = b[rows, best[0]] <= best[1]
        return (*best, self._grow(b, g, h, rows[down], depth - 1), self._grow(b, g, h, rows[~down], depth - 1))

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, cut, low, high = tree
        return np.where(b[:, f] <= cut, self._apply(low, b), self._apply(high, b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1."""
        score = np.full(len(x), self.base)
        if self.trees and len(x):
            b = self._bin(x)
            for tree in self.trees:
                score += self._apply(tree, b)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(ruled: DataFrame, rates: Rates, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` of the URLs that a rule decides; 1 stands for block. A row's statistics leave out its fold of
    hosts, so that they say what they would of a host never seen."""
    columns = ("url", "host", "path", "fold", (F.col("rule_verdict") == "block").cast("int").alias("y"))
    labelled = with_fold(ruled).where("rule is not null")
    n = labelled.count()
    if n > sample:
        # a share of all rows by hash, so that no task sends more than its part of the sample
        labelled = labelled.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / n))
    rows = labelled.select(*columns).limit(sample).toArrow().combine_chunks()
    fold, y = (rows.column(c).to_numpy() for c in ("fold", "y"))
    x = np.zeros((len(y), len(FEATURES)))
    for f in np.unique(fold):
        own = rows.filter(pa.array(fold == f)).combine_chunks()
        x[fold == f] = features(*(_whole(own.column(c)) for c in ("url", "host", "path")), rates.without(f))
    # each row also stands as one of an unknown suffix, and as one of an unknown segment: 0 must not fall to a side by accident
    forms = [x, x.copy(), x.copy()]
    forms[1][:, FEATURES.index("suffix_rate")] = 0
    forms[2][:, FEATURES.index("segment_rate")] = 0
    return Trees().fit(np.concatenate(forms), np.tile(y.astype(float), 3))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of block, of every row."""
    ruled = with_rules(df, rules, id_col, url_col)
    rates = label_rates(ruled)
    model, known = fit(ruled, rates, sample), rates.without()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "url"):
            p = model.predict(features(*(batch.column(c) for c in ("url", "host", "path")), known))
            verdict = pc.coalesce(batch.column("rule_verdict"), pa.array(np.where(p >= 0.5, "block", "allow"), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), verdict, pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return ruled.mapInArrow(judge, f"page_id {dict(ruled.dtypes)['page_id']}, host string, path string, rule string, verdict string, p_block double")
