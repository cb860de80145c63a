"""Quality classifier with hierarchical empirical Bayes (operator 3).

A logistic classifier on a document's shape (pairs of character classes, lengths, repetition) gives its own evidence. Sites form
two levels, host and path. Each level's mean quality (labels where there are any, else the classifier's estimates) is shrunk
towards the level above, by a strength that the spread of all sites' means gives: sparse sites stay near the global mean. The
document's log odds and its path's, relative to the global mean, add up. Sites are summed in folds by a hash of the document's id, and
a document's site leaves out its own fold, so that neither its own estimate nor its label counts a second time.

Nulls and ties: a null text is empty; a null host or path is one of its own (empty). Several labels of a document are averaged; null
labels are left out. With no label, or labels of one kind only, the classifier is a constant and everything gets that
mean (one half without labels). Equal rows get equal results. Whole texts of any length are read. No rows: no rows out. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices, spill

#: The most labelled rows that the classifier is fitted on, picked by a hash of the id.
SAMPLE = 20_000
RIDGE, STEPS = 1.0, 12
#: Bounds of the strength of a level's prior, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
KEEP = 0.5
#: Folds of documents that a site's statistics leave out.
FOLDS = 16

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?'\"-()", "!#$%&*+/<=>@[\\]^_`{|}~")
#: Class of each byte; bytes of characters beyond ASCII count as lower-case letters, control characters as the last class.
CLASS = bytes(next((i for i, c in enumerate(_CLASSES) if chr(b) in c), 0 if b >= 0x80 else 7) for b in range(256))
N_FEATURES = 64 + 5


def features(text: str | None) -> np.ndarray:
    """Shares of pairs of character classes; then lengths and repetition."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float32)
    kinds = np.frombuffer(raw.translate(CLASS), np.uint8)
    if len(kinds) > 1:
        out[:64] = np.bincount(8 * kinds[:-1] + kinds[1:], minlength=64) / (len(kinds) - 1)
    words, lines = raw.split(), raw.splitlines()
    out[64:] = (
        math.log1p(len(raw)), len(raw) / (len(words) + 1), len(set(words)) / (len(words) + 1), 1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) / 100,
    )
    return out


class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton's method; labels may lie between 0 and 1."""

    def __init__(self):
        self.mean, self.scale, self.weights, self.base = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.r_[np.full(N_FEATURES, RIDGE), 1e-6]
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z.T * np.maximum(p * (1 - p), 1e-4)) @ z + np.diag(penalty)
            w += np.clip(np.linalg.solve(h, z.T @ (y - p) - penalty * w), -3, 3)
        self.weights, self.base = w[:-1], float(w[-1])
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.base, -12, 12)


def document_features(df: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, x of every row."""
    empty = F.lit("")
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), empty).alias("host"), F.coalesce(path.cast("string"), empty).alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.stack([features(t) for t in batch.column("text").to_pylist()])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), values], names=["doc_id", "host", "path", "x"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, host string, path string, x array<float>")


def mean_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    labels = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where("label_id is not null and y is not null")
    return labels.groupBy("label_id").agg(F.avg("y").alias("y"))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Logistic:
    """A classifier fitted on at most ``sample`` of the rows (doc_id, x, y) that have a label."""
    known = rows.where("y is not null").select("doc_id", "x", "y")
    n = known.count()
    if n > sample:
        share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / n)
        known = known.where(share)
    found = known.limit(sample).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)
    return Logistic().fit(x, found.column("y").to_numpy())


def with_log_odds(rows: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, host, path, y and the classifier's log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path", "y")), pa.array(model.log_odds(x), pa.float64())], names=["doc_id", "host", "path", "y", "log_odds"])

    return rows.select("doc_id", "host", "path", "y", "x").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, host string, path string, y double, log_odds double")


def strength(between: float | None, within: float) -> float:
    """A Beta prior's strength, from the variance of the sites' means beyond that of their samples."""
    return STRONGEST if not between or between <= 0 else min(STRONGEST, max(WEAKEST, within / between - 1))


def fold_of(id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(FOLDS)).cast("int")


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """host, path, fold, p_host, p_path for the documents of each path and fold, from all others; and the global mean."""
    good = F.coalesce("y", 1 / (1 + F.exp(-F.col("log_odds"))))
    folds = spill(scored.groupBy("host", "path", fold_of().alias("fold")).agg(F.count(F.lit(1)).alias("fn"), F.sum(good).alias("fk")), "site-folds")
    host_folds = spill(folds.groupBy("host", "fold").agg(F.sum("fn").alias("hfn"), F.sum("fk").alias("hfk")), "host-folds")
    paths = spill(folds.groupBy("host", "path").agg(F.sum("fn").alias("n"), F.sum("fk").alias("k")), "paths")
    hosts = spill(host_folds.groupBy("host").agg(F.sum("hfn").alias("hn"), F.sum("hfk").alias("hk")), "hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k"), F.count(F.lit(1)).alias("sites")).first()
    mean = min(1 - 1e-4, max(1e-4, total["k"] / total["n"])) if total["n"] else 0.5
    spread = mean * (1 - mean)
    # weighted variance of the means, less what samples of that size vary by themselves
    over = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hk") / F.col("hn") - mean, 2)).alias("v")).first()["v"]
    between = (over - spread * (total["sites"] - 1)) / total["n"] if total["n"] else None
    s_host = strength(between, spread)
    both = spill(paths.join(hosts, "host"), "paths-of-hosts")
    inner = both.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("hk") / F.col("hn"), 2)).alias("v"), F.count(F.lit(1)).alias("c")).first()
    within = (inner["v"] - spread * (inner["c"] - total["sites"])) / total["n"] if total["n"] else None
    s_path = strength(within, spread)
    out = folds.join(both, ["host", "path"]).join(host_folds, ["host", "fold"])
    out = out.withColumn("p_host", (F.col("hk") - F.col("hfk") + s_host * mean) / (F.col("hn") - F.col("hfn") + s_host))
    out = out.withColumn("p_path", (F.col("k") - F.col("fk") + s_path * F.col("p_host")) / (F.col("n") - F.col("fn") + s_path))
    return spill(out.select("host", "path", "fold", "p_host", "p_path"), "sites"), mean


def log_odds_of(p: Column | float) -> Column | float:
    return math.log(p / (1 - p)) if isinstance(p, float) else F.log(p / (F.lit(1.0) - p))


def posterior(log_odds: Column, p_path: Column, mean: float) -> Column:
    p_path = F.least(F.greatest(p_path, F.lit(1e-4)), F.lit(1 - 1e-4))
    return 1 / (1 + F.exp(-(log_odds + log_odds_of(p_path) - log_odds_of(float(mean)))))


def learn(df: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[Logistic, DataFrame, DataFrame, float]:
    """The classifier, the scored rows (doc_id, host, path, y, log_odds), the sites and the global mean."""
    found = document_features(df, id_col, text_col, host, path)
    rows = spill(found, "document-features")
    y = mean_labels(labels, id_col, label_col)
    rows = rows.join(y, rows["doc_id"] == y["label_id"], "left").drop("label_id")
    model = fit(rows, sample)
    scored = spill(with_log_odds(rows, model), "document-scores")
    sites, mean = site_posteriors(scored)
    return model, scored, sites, mean


def classify(df: DataFrame, labels: DataFrame, host: Column, path: Column, **names) -> DataFrame:
    """doc_id, p_document, p_host, p_path, p_quality, keep (p_quality of KEEP or more) and changed (whether the site decides that, and not
    the document alone) of every row."""
    _, scored, sites, mean = learn(df, labels, host, path, **names)
    out = scored.withColumn("fold", fold_of()).join(sites, ["host", "path", "fold"]).withColumn("p_quality", posterior(F.col("log_odds"), F.col("p_path"), mean))
    own = 1 / (1 + F.exp(-F.col("log_odds")))
    keep = F.col("p_quality") >= KEEP
    return out.select("doc_id", own.alias("p_document"), "p_host", "p_path", "p_quality", keep.alias("keep"), (keep != (own >= KEEP)).alias("changed"))


def keep_good(df: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of df with p_quality of KEEP or more. Texts are scored again, where they are, and never shuffled by document."""
    model, _, sites, mean = learn(df, labels, host, path, id_col=id_col, text_col=text_col, **names)
    empty = F.lit("")
    marked = df.withColumn("__host", F.coalesce(host.cast("string"), empty)).withColumn("__path", F.coalesce(path.cast("string"), empty)).withColumn("__fold", fold_of(id_col))
    columns = marked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            x = np.stack([features(t) for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.log_odds(x), pa.float64())], names=[*columns, "__log_odds"])

    scored = marked.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in marked.dtypes) + ", `__log_odds` double")
    sites = sites.select(*(F.col(c).alias(f"__s_{c}") for c in ("host", "path", "fold", "p_path")))
    same = [F.col(f"__{c}") == F.col(f"__s_{c}") for c in ("host", "path", "fold")]
    return scored.join(sites, same).where(posterior(F.col("__log_odds"), F.col("__s_p_path"), mean) >= KEEP).select(*df.columns)
