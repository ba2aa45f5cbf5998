"""Document quality by hierarchical empirical Bayes.

A logistic regression on plain features of a text gives each document's own evidence. Grouped sums of that evidence
give each host's and each path's posterior mean: a path shrinks towards its host and a host towards the global mean,
by strengths that the method of moments takes from the spread between hosts and between paths. A document's posterior
adds to its own log odds those of its path over the global ones, so that a sparse site changes little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._util import cut, small_side


def features(text: Column) -> list[Column]:
    """Shares and lengths, each bounded or a logarithm; all defined for an empty text."""
    share = lambda pattern: 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))
    words, lines = F.split(text, " "), F.split(text, "\n")
    return [
        share(r"\p{L}"),
        share(r"\p{Lu}"),
        share(r"[0-9]"),
        share("!"),
        share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        F.size(F.array_distinct(words)) / F.size(words),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(F.length(text) / F.size(words)),
        F.log1p(F.size(words).cast("double")),
        F.log1p(F.length(text) / F.size(lines)),
    ]


def fit(rows: list[tuple], ridge: float = 1e-2, rounds: int = 30):
    """(weights, bias) of an L2-penalised logistic regression by Newton's method on (feature..., label) rows; zero weights where only one label occurs."""
    import numpy as np

    if not rows or len({r[-1] for r in rows}) < 2:
        n = len(rows[0]) - 1 if rows else 0
        return [0.0] * n, 3.0 if not rows or rows[0][-1] else -3.0
    data = np.array(sorted(rows), dtype=float)
    x, y = data[:, :-1], data[:, -1]
    mean, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge * len(x) / 100), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    weights = w[:-1] / spread
    return weights.tolist(), float(w[-1] - weights @ mean)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000):
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids."""
    some = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("double").alias("__y"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select(*(f.alias(f"f{i}") for i, f in enumerate(features(F.coalesce("text", F.lit(""))))), "__y")
    return fit([tuple(r) for r in known.limit(sample_rows).collect()])


def evidence(model, text: Column) -> Column:
    """The log odds of good quality from a document's own text."""
    weights, bias = model
    out = F.lit(bias)
    for w, f in zip(weights, features(text)):
        out = out + F.lit(w) * f
    return F.least(F.greatest(out, F.lit(-12.0)), F.lit(12.0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, centre: Column) -> tuple[float, float, float]:
    """(cases, sum, prior strength) by the method of moments: how many cases the mean above a group weighs as much as."""
    m = F.col(s) / F.col(n)
    r = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.count("*").alias("k"), F.sum(F.col(n) * F.pow(m - centre, 2)).alias("ss"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not r.n:
        return 0.0, 0.0, 1.0
    mean = min(max(r.s / r.n, 1e-6), 1 - 1e-6)
    inside = mean * (1 - mean)
    between = (r.ss - (r.k - 1) * inside) / max(r.n - r.nn / r.n, 1e-9)
    return float(r.n), float(r.s), float(min(max(inside / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def site_posteriors(scored: DataFrame) -> DataFrame:
    """scored: (host, path, p). (host, path, host_posterior, path_posterior, prior): one row for each path, the prior is the global mean."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    total, good, _ = _strength(hosts, "hn", "hs", F.lit(0.0))
    mean = min(max(good / total, 1e-6), 1 - 1e-6) if total else 0.5
    _, _, a = _strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + a * mean) / (F.col("hn") + a))
    both = paths.join(hosts, "host")
    _, _, b = _strength(both.withColumn("centre", F.col("host_posterior")), "n", "s", F.col("centre"))
    return both.select("host", "path", "host_posterior", ((F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior"), F.lit(mean).alias("prior"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, least: float = 0.5, broadcast_rows: int = 100_000, sample_rows: int = 20_000) -> DataFrame:
    """(doc, quality) for every row of ``docs``: its columns, of any name, as the struct ``doc``, and the struct ``quality`` of evidence, host, path, host_posterior, path_posterior, posterior and keep.

    A document is kept if its posterior probability is at least ``least``. Null texts count as empty, null hosts and
    paths as sites of their own; without labels of both kinds all documents get the same evidence. Empty tables give
    no rows; repeated rows are each scored, and each counts for its site. Site sums are aggregated before they are shuffled; the site table is broadcast up to ``broadcast_rows``.
    """
    model = train(docs, labels, sample_rows)
    logit = evidence(model, F.coalesce("text", F.lit("")))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    scored = docs.select(doc, F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), logit.alias("evidence"))
    sites = cut(site_posteriors(scored.select("host", "path", (1 / (1 + F.exp(-F.col("evidence")))).alias("p"))))
    joined = scored.join(small_side(sites, broadcast_rows), ["host", "path"])
    odds = F.col("evidence") + _logit(F.col("path_posterior")) - _logit(F.col("prior"))
    placed = joined.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    quality = F.struct("evidence", "host", "path", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= least).alias("keep"))
    return placed.select("doc", quality.alias("quality"))
