import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import quality


def test_features_of_texts():
    assert quality.features(None).tolist() == quality.features("").tolist()
    a, b = quality.features("THE!! LOUD!! WORDS!!"), quality.features("calm and quiet words")
    assert a.shape == (quality.N_FEATURES,) and np.abs(a - b).sum() > 0.5


def test_logistic_separates_and_handles_constants():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2400, quality.N_FEATURES))
    y = (x[:, 0] + 0.1 * rng.normal(size=2400) > 0).astype(float)
    p = quality.Logistic().fit(x[:2000], y[:2000]).log_odds(x[2000:]) > 0
    assert (p == (y[2000:] > 0)).mean() > 0.9
    assert quality.Logistic().fit(x[:0], y[:0]).log_odds(x[:2]).tolist() == [0, 0]
    assert (quality.Logistic().fit(x[:3], np.ones(3)).log_odds(x[:2]) > 0).all()


def test_held_out_labels(spark, sf, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    found = quality.classify(docs, train, F.col("source"), F.concat_ws("/", "source", "lang")).join(test, "doc_id")
    right = found.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.95


def brute_sites(rows, fold):
    """(host, path, fold) to (p_host, p_path), and the mean; rows: (id, host, path, y, log odds)."""
    good = {r[0]: r[3] if r[3] is not None else 1 / (1 + np.exp(-r[4])) for r in rows}
    m, v = np.mean(list(good.values())), None
    v = m * (1 - m)

    def grouped(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[0])
        return out

    hosts, paths = grouped(lambda r: r[1]), grouped(lambda r: (r[1], r[2]))
    at = lambda ids: np.mean([good[i] for i in ids])
    between = (sum(len(g) * (at(g) - m) ** 2 for g in hosts.values()) - v * (len(hosts) - 1)) / len(rows)
    within = (sum(len(g) * (at(g) - at(hosts[h])) ** 2 for (h, _), g in paths.items()) - v * (len(paths) - len(hosts))) / len(rows)
    s_host, s_path = quality.strength(between, v), quality.strength(within, v)
    out = {}
    for r in rows:
        others = [i for i in hosts[r[1]] if fold[i] != fold[r[0]]]
        p_host = (sum(good[i] for i in others) + s_host * m) / (len(others) + s_host)
        own = [i for i in paths[r[1], r[2]] if fold[i] != fold[r[0]]]
        out[r[1], r[2], fold[r[0]]] = p_host, (sum(good[i] for i in own) + s_path * p_host) / (len(own) + s_path)
    return out, m


def test_posteriors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"h{i % 5}", f"h{i % 5}/{i % 3}", [float(rng.random() < 0.2 + 0.15 * (i % 5)), None][i % 7 == 0], float(rng.normal())) for i in range(400)] + [(999, "lone", "lone/x", None, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, y double, log_odds double")
    sites, mean = quality.site_posteriors(df)
    fold = {r["doc_id"]: r["f"] for r in df.select("doc_id", quality.fold_of().alias("f")).collect()}
    want, m = brute_sites(rows, fold)
    assert abs(mean - m) < 1e-12
    got = {(r["host"], r["path"], r["fold"]): (r["p_host"], r["p_path"]) for r in sites.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert abs(want["lone", "lone/x", fold[999]][1] - m) < 1e-9  # a site of one document says nothing of it


def test_classify_matches_brute_force(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    site = (F.col("source"), F.concat_ws("/", "source", "lang"))
    model, scored, _, _ = quality.learn(docs, labels, *site)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], r["host"], r["path"], r["y"], r["log_odds"]) for r in scored.collect()]
    assert all(r[3] == known.get(r[0]) and abs(r[4] - model.log_odds(quality.features(texts[r[0]])[None])[0]) < 1e-5 for r in rows)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", quality.fold_of().alias("f")).collect()}
    sites, m = brute_sites(rows, fold)
    where = {r[0]: r for r in rows}
    for r in quality.classify(docs, labels, *site).collect():
        _, host, path, _, odds = where[r["doc_id"]]
        p_host, p_path = sites[host, path, fold[r["doc_id"]]]
        clipped = min(1 - 1e-4, max(1e-4, p_path))
        p = 1 / (1 + np.exp(-(odds + np.log(clipped / (1 - clipped)) - np.log(m / (1 - m)))))
        own = 1 / (1 + np.exp(-odds))
        assert np.allclose([r["p_document"], r["p_host"], r["p_path"], r["p_quality"]], [own, p_host, p_path, p], atol=1e-6)
        assert r["keep"] == (r["p_quality"] >= 0.5) and r["changed"] == (r["keep"] != (r["p_document"] >= 0.5))


def test_sparse_sites_help_where_texts_say_little(spark):
    """Sites of 2 to 30 documents whose quality differs, texts that hint at it: with their sites, held-out labels are met more often."""
    rng, rows, labels = np.random.default_rng(7), [], []
    for host in range(60):
        level = rng.beta(0.7, 0.7)
        for path in range(rng.integers(1, 4)):
            share = np.clip(level + rng.normal(0, 0.1), 0.02, 0.98)
            for _ in range(rng.integers(2, 11)):
                good, doc = int(rng.random() < share), len(rows)
                shouts = rng.random() < (0.35 if good else 0.65)
                rows.append((doc, ("SO LOUD!!! " if shouts else "quite calm words ") * 5, f"h{host}", f"h{host}/{path}"))
                labels.append((doc, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    truth = dict(labels)
    found = [r for r in quality.classify(docs, known, F.col("host"), F.col("path")).collect() if r["doc_id"] % 2 == 0]
    alone = np.mean([(r["p_document"] >= 0.5) == truth[r["doc_id"]] for r in found])
    with_site = np.mean([r["keep"] == truth[r["doc_id"]] for r in found])
    assert with_site >= alone + 0.05 and sum(r["changed"] for r in found) > 20


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int")
    site = (F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = quality.classify(odd_docs, labels, *site).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["p_quality"] <= 1 for r in rows)
    assert quality.keep_good(odd_docs, labels, *site).columns == odd_docs.columns
    assert quality.classify(no_docs, labels, *site).collect() == [] and quality.keep_good(no_docs, labels, *site).collect() == []
    none = labels.where("quality = 5")
    assert {round(r["p_quality"], 6) for r in quality.classify(odd_docs, none, *site).collect()} == {0.5}


def test_filter_agrees_with_scores(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    site = (F.col("source"), F.concat_ws("/", "source", "lang"))
    keep = {r["doc_id"] for r in quality.classify(docs, labels, *site).where("keep").collect()}
    kept = quality.keep_good(docs, labels, *site)
    assert {r["doc_id"] for r in kept.collect()} == keep and kept.columns == docs.columns
