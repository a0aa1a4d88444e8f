"""Document quality by hierarchical empirical Bayes.

Evidence of the document: a logistic regression on shares of its words that look odd and on hashed word and character
n-grams, fitted on a bounded sample of labelled rows (``SAMPLE``). Evidence of its site: labels are counted for every (host, path) and host; a path's share of good documents
is shrunk toward its host's, and the host's toward the global share. How strongly comes from the data: at each level the
prior weight is the one whose beta-binomial variance between groups matches the observed one (method of moments), so
sites with few labels stay near their parent and sites with many speak for themselves.

posterior log-odds = classifier log-odds - log-odds of its training sample + log-odds of the path's shrunk share.

The site's host and path are columns that the caller names; the documents of the queries have no address, so there the
host is the source and the path below it the language's part of that source.

Scale: counts are grouped aggregations with partial sums over all labels, so a host with a third of the rows is summed
where its rows lie; features are computed in one pass over whole texts. Shares of few enough sites are broadcast, and
then no document moves; beyond that sites and documents meet in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import bounded, checkpointed, text_or_empty, text_slices, whole_row, workers_import
from vantrail.llm.neardup import word_hashes

#: Labelled rows the classifier is fitted on at most, chosen by a hash of their key.
SAMPLE = 10_000
#: The ridge of the fit, and bounds of the prior weight in labels.
RIDGE, LEAST_WEIGHT, MOST_WEIGHT = 1e-3, 1.0, 1e4
#: Buckets of the words and pairs of words of a text, and of its runs of three bytes; the ridge of their standardised
#: shares a row, and rows that count as seen before the first, so that small samples rest on the few features.
WORD_BUCKETS, BYTE_BUCKETS, GRAM_RIDGE, GRAM_ROWS = 128, 128, 0.05, 1000
FEATURES = ("upper", "symbol", "repeat", "stale", "digit", "long", "size")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()\-–—?¿¡«»/@]")
_DIGIT = re.compile(r"\d")
_LONG = 30


def features_of(text: str) -> tuple[float, ...]:
    """Shares, 0 to 1, of words in capitals, with symbols, equal to the word before, seen before, with digits, very long; log10 of words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    fresh = len(set(words)) / min(n, 200 + n // 4)  # long texts repeat common words
    upper = sum(len(w) > 1 for w in filter(str.isupper, words))
    symbol = sum(1 for w in words if _SYMBOL.search(w)) if _SYMBOL.search(text) else 0
    digit = sum(1 for w in words if _DIGIT.search(w)) if _DIGIT.search(text) else 0
    return upper / n, symbol / n, sum(map(eq, words, words[1:])) / n, max(0.0, 1 - fresh), digit / n, sum(len(w) > _LONG for w in words) / n, float(np.log10(1 + n))


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the square roots of the shares of its words and pairs of words in their buckets, and of its runs of three bytes (small
    letters, any white space alike) in theirs. Zero where there are none."""
    n = len(offsets) - 1
    hashed, at = word_hashes(data, offsets)
    row = np.repeat(np.arange(n), np.diff(at))
    pair = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:]) >> np.uint64(20) if len(hashed) else hashed
    same = row[:-1] == row[1:]
    words = np.concatenate([row * WORD_BUCKETS + (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64), (row[:-1] * WORD_BUCKETS + (pair % np.uint64(WORD_BUCKETS)).astype(np.int64))[same]])
    plain = np.where((data >= 65) & (data <= 90), data + 32, np.where((data >= 9) & (data <= 13), 32, data)).astype(np.uint32)
    run = (plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16) if len(data) > 2 else np.empty(0, np.uint32)
    of = np.repeat(np.arange(n), np.diff(offsets))
    inside = of[:-2] == of[2:]
    runs = (of[:-2] * BYTE_BUCKETS + (run % np.uint32(BYTE_BUCKETS)))[inside] if len(data) > 2 else np.empty(0, np.int64)
    parts = []
    for cells, buckets in ((words, WORD_BUCKETS), (runs, BYTE_BUCKETS)):
        count = np.bincount(cells, minlength=n * buckets).reshape(n, buckets)
        parts.append(np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True))))
    return np.concatenate(parts, axis=1).astype(np.float32)


def with_features(docs: DataFrame, evidence: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows with a column ``text`` and others of an operator's own: these others and the features and n-gram shares, or the evidence that a
    function makes of these."""
    workers_import(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    docs = docs.select(*keep, text_or_empty())
    own = [T.StructField(f, T.DoubleType()) for f in FEATURES] + [T.StructField("grams", T.BinaryType())] if evidence is None else [T.StructField("evidence", T.DoubleType())]
    schema = T.StructType([*[docs.schema[c] for c in keep], *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches, len(keep)):
            found = np.array([features_of(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            grams = grams_of(data, offsets)
            if evidence is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(evidence(found, grams), pa.float64())], names=[*keep, "evidence"])
                continue
            packed = pa.array([g.tobytes() for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(found[:, i].copy()) for i in range(len(FEATURES))], packed], names=[*keep, *FEATURES, "grams"])

    return docs.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def fit(x: np.ndarray, grams: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first, for the features, their square roots and the n-gram shares) of a ridge logistic regression, and
    the log-odds of the sample, smoothed so that one class alone or no rows give finite numbers. Shares are penalised as if
    standardised."""
    spread = np.maximum(grams.std(axis=0, dtype=np.float64), 1e-4) if len(grams) else np.ones(grams.shape[1])
    middle = grams.mean(axis=0, dtype=np.float64) if len(grams) else np.zeros(grams.shape[1])
    design = np.column_stack([np.ones(len(x)), x, np.sqrt(x), (grams - middle) / spread]).astype(np.float32)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    beta = np.zeros(design.shape[1])
    beta[0] = base
    penalty = np.full(len(beta), RIDGE * max(1, len(y)))
    penalty[1 + 2 * x.shape[1] :] = GRAM_RIDGE * (len(y) + GRAM_ROWS)
    penalty[0] = 0.5
    pull = np.zeros(len(beta))
    pull[0] = base
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty * (beta - pull)
        hessian = np.diag(penalty)
        for lo in range(0, len(design), 2048):
            part = design[lo : lo + 2048].astype(np.float64)
            hessian += (part * (p * (1 - p))[lo : lo + 2048, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    beta[1 + 2 * x.shape[1] :] /= spread
    beta[0] -= beta[1 + 2 * x.shape[1] :] @ middle
    return beta, base


def _weight(good: str, n: str, mean: Column) -> Column:
    """The prior weight of a level, one value over all its groups: method of moments on the groups' shares around their mean."""
    off = F.col(good) / F.col(n) - mean
    level = F.avg(mean * (1 - mean))
    # a group of n labels adds n off^2, of which mean (1 - mean) is sampling noise and (n - 1) spread the rest
    spread = (F.sum(F.col(n) * off * off) - F.sum(mean * (1 - mean))) / F.greatest(F.lit(1.0), F.sum(F.col(n) - 1))
    weight = F.when(spread > 0, level / spread - 1).otherwise(F.lit(MOST_WEIGHT))
    return F.least(F.greatest(F.coalesce(weight, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """From rows (host, path, good): (host, path, path_share), (host, host_share) and the global share."""
    paths = labelled.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    share = ((total[0] or 0.0) + 0.5) / ((total[1] or 0.0) + 1.0)
    of_host = hosts.agg(_weight("good", "n", F.lit(share))).first()[0]
    hosts = hosts.select("host", ((F.col("good") + of_host * share) / (F.col("n") + of_host)).alias("host_share"))
    paths = paths.join(hosts, "host")
    of_path = paths.agg(_weight("good", "n", F.col("host_share"))).first()[0]
    return paths.select("host", "path", ((F.col("good") + of_path * F.col("host_share")) / (F.col("n") + of_path)).alias("path_share")), hosts, share


def _scored(docs: DataFrame, labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """From rows (key, text, host, path, ...): all but the text, and evidence, host_share, path_share, quality."""
    docs = docs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("host", "path")})
    slim = docs.select("key", "text", "host", "path")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("good"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = slim.select("key", "text").join(F.broadcast(chosen), "key")  # ``sample`` keys
    rows = with_features(texts).groupBy("key").agg(*[F.min(c).alias(c) for c in ("good", *FEATURES, "grams")]).orderBy("key").toPandas()  # a row a key, numbers only
    grams = np.frombuffer(b"".join(map(bytes, rows["grams"])), dtype=np.float32).reshape(-1, WORD_BUCKETS + BYTE_BUCKETS)
    beta, base = fit(rows[list(FEATURES)].to_numpy(float), grams, (rows["good"] >= 0.5).to_numpy(float))
    paths, hosts, share = site_posteriors(slim.select("key", "host", "path").join(known, "key"))
    paths, hosts = checkpointed(paths), checkpointed(hosts)

    def evidence(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return beta[0] - base + np.concatenate([x, np.sqrt(x), shares], axis=1) @ beta[1:]

    found = with_features(docs, evidence)
    found = found.join(bounded(paths), ["host", "path"], "left").join(bounded(hosts), "host", "left")
    found = found.withColumn("host_share", F.coalesce("host_share", F.lit(share))).withColumn("path_share", F.coalesce("path_share", "host_share"))
    return found.withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share"))))))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(key, evidence, host_share, path_share, quality, kept) for every row: the document's log-odds against its sample's, the
    shrunk shares of its site, the posterior probability of good quality, and whether that reaches ``threshold``.

    ``labels`` has the key and 0/1 labels; null labels and keys are ignored, several labels of one key are averaged. A null text is
    empty; null hosts and paths are sites like others; a site without labels takes its parent's share. Without any label
    every probability is one half, and all are kept at the default threshold. Repeated rows repeat. No rows give none. Other
    columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    found = _scored(rows, labels, key, label, sample)
    return found.select(F.col("key").alias(key), "evidence", "host_share", "path_share", "quality", (F.col("quality") >= threshold).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns as they were, whatever their names. Each row carries its own verdict, so
    repeated and null keys do no harm, and texts move only where the sites are too many to broadcast."""
    rows = docs.select(whole_row(docs), F.col(key).alias("key"), F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    return _scored(rows, labels, key, label, sample).where(F.col("quality") >= threshold).select("row.*")
