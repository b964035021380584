"""Quality classifier: document evidence, shrunk through path and host towards a global prior.

A logistic model judges each document by general evidence over its whole text (hashed character n-grams, Unicode
classes and how they follow each other, repeated word n-grams); it is fitted on at most `max_train_rows` labelled
rows. Hierarchical empirical Bayes then adds what is known of the site:

* the mean of all documents' probabilities is the prior of the hosts; the mean of a host, drawn to that
  prior, is the prior of its paths;
* how strongly a mean is drawn to its prior is itself estimated from the data, by moments: the more
  alike the groups of a level, the stronger. A host or path of few documents stays near its prior;
* the final odds of a document are its own odds, moved by how far its path lies from the global mean.

All counts are grouped sums over all rows, so a host that holds a third of them costs what any other does.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.text import text_or_empty
from burstline.llm.workers import give_back, text_batches

NGRAM = 4  # characters of a hashed n-gram
_BUCKET_BITS = 11
_KINDS = 6  # of characters: other, small or caseless letter, capital, number, punctuation or symbol, space
_MEASURES = 5
_DIM = _MEASURES + _KINDS * _KINDS + (1 << _BUCKET_BITS)
# sites go to every task below this many rows, else they are joined
SMALL_TABLE = 100_000
_EDGE = 1e-6
_SLICE = 256


@dataclass(frozen=True)
class QualityParams:
    max_train_rows: int = 20_000  # labelled rows the document model is fitted on
    regularisation: float = 1e-3
    site_weight: float = 0.5  # how much of the site's shift in log odds a document takes on
    threshold: float = 0.5  # documents below this probability are rejected


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    of = {"L": 1, "M": 1, "N": 3, "P": 4, "S": 4, "Z": 5}
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        name = unicodedata.category(chr(c))
        out[c] = 2 if name in ("Lu", "Lt") else of.get(name[0], 0)
    out[[9, 10, 11, 12, 13]] = 5
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def evidence(text: str) -> np.ndarray:
    """What the document model sees of a whole text, each number in 0..1: shares of marks, capitals, numbers and
    repeated word n-grams, how short the text is, the shares of pairs of kinds of neighbouring characters, and
    those of the hashed character n-grams."""
    out = np.zeros(_DIM)
    codes = _codes(text)
    if not codes.size:
        return out
    kinds = _kinds()[codes]
    count = np.bincount(kinds, minlength=_KINDS) / codes.size
    words = text.split()
    again = 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 0.0
    for i, (share, half) in enumerate(((count[4], 0.05), (count[2], 0.3), (count[3], 0.2), (again, 0.1))):
        out[i] = share / (share + half)
    out[4] = 1 / max(1, len(words))
    pairs = kinds[:-1] * np.uint8(_KINDS) + kinds[1:]
    out[_MEASURES:_MEASURES + _KINDS * _KINDS] = np.sqrt(
        np.bincount(pairs, minlength=_KINDS * _KINDS) / max(1, pairs.size))
    lower = _codes(text.lower())
    n = lower.size - NGRAM + 1
    if n > 0:
        h = np.zeros(n, np.uint32)
        for k in range(NGRAM):
            h = (h ^ lower[k:k + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out[_MEASURES + _KINDS * _KINDS:] = np.sqrt(
            np.bincount(h >> np.uint32(32 - _BUCKET_BITS), minlength=1 << _BUCKET_BITS) / n)
    return out


def _as_vector(text: str) -> SparseVector:
    x = evidence(text)
    at = np.flatnonzero(x)
    return SparseVector(_DIM, at, x[at])


@dataclass(frozen=True)
class DocumentModel:
    intercept: float
    weights: list[float]

    def log_odds(self, text: Column) -> Column:
        """Of whole texts, which are not null."""
        intercept, weights = self.intercept, np.array(self.weights)

        def judged(texts: pa.Array) -> pa.Array:
            out = []
            for lo in range(0, len(texts), _SLICE):  # few texts at a time are copied out of the batch
                out += [intercept + float(evidence(t) @ weights) for t in texts.slice(lo, _SLICE).to_pylist()]
            give_back()
            return pa.array(out, pa.float64())

        # never null, and Spark should know: else a filter on the odds has it look for nulls first, judging each text twice
        own = F.lit(intercept)
        return F.coalesce(F.arrow_udf(judged, "double")(text), own) if weights.any() else own


def _probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(p / (F.lit(1.0) - p))


def fit_document_model(texts: DataFrame, labels: DataFrame, params: QualityParams) -> DocumentModel:
    """Logistic regression over at most `max_train_rows` labelled rows of `texts` (doc_id, text).

    Labels: doc_id, quality; null ones are left out, and of several for one id the lowest counts. With
    labels of one kind only, or none, the model gives every document the same odds of 1000 to 1 (to 1
    to 1000 if all labels are bad).
    """
    good = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    # the bounded sample: spread by the hash of the id; only hashes are sorted, the texts of the sample follow
    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), "text")
    sample = cut(keyed.select("doc_id", "key").join(good, "doc_id")
                 .orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(params.max_train_rows)
                 .groupBy("doc_id", "key", "label").agg(F.count("*").cast("double").alias("n")))
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        return DocumentModel(-6.9 if kinds == {0.0} else 6.9, [0.0] * _DIM)
    vector = F.udf(lambda text: _as_vector(text), VectorUDT())
    rows = cut(keyed.join(F.broadcast(sample), ["doc_id", "key"])
               .groupBy("doc_id", "key", "label", "n").agg(F.first("text").alias("text"))
               .select("label", "n", vector("text").alias("features"))).coalesce(6)
    # the sample is bounded, so a few tasks a round do; shares are on one scale as they are: scaled up to equal variance, rare n-grams would drown the others
    model = LogisticRegression(regParam=params.regularisation, maxIter=60, standardization=False,
                               weightCol="n").fit(rows)
    return DocumentModel(float(model.intercept), [float(x) for x in model.coefficients.toArray()])


def _pull(n_rows: float, n_groups: float, square_sum: float, between: float, within: float) -> float:
    """Pseudo-counts of the prior: variance inside groups over variance between them (moments)."""
    if n_rows <= n_groups or n_groups < 2:
        return 1.0
    inside = within / (n_rows - n_groups)
    across = (between - (n_groups - 1) * inside) / max(n_rows - square_sum / n_rows, 1e-9)
    return min(max(inside, 1e-9) / across, 1e9) if across > 0 else 1e9


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p_host, p_path) of `scored` (host, path, p), and the global mean."""
    paths = cut(scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    if not total["n"]:
        return paths.select("host", "path", F.lit(0.5).alias("p_host"), F.lit(0.5).alias("p_path")), 0.5
    mean = total["s"] / total["n"]

    def pull(groups: DataFrame, prior: Column) -> float:
        r = groups.agg(
            F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2)).alias("between"),
            F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
        return _pull(r["n"], r["k"], r["nn"], r["between"], r["within"])

    by_host = pull(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + F.lit(by_host * mean)) / (F.col("n") + F.lit(by_host))).alias("p_host"))
    paths = paths.join(hosts, "host")
    by_path = pull(paths, F.col("p_host"))
    return cut(paths.select("host", "path", "p_host", (
        (F.col("s") + F.lit(by_path) * F.col("p_host")) / (F.col("n") + F.lit(by_path))).alias("p_path"))), mean


def _sites_of(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    return docs.select("*", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


@dataclass(frozen=True)
class QualityModel:
    """A fitted classifier: the document model, the sites' posteriors, and the columns that name a site."""

    model: DocumentModel
    sites: DataFrame
    mean: float
    host: Column
    path: Column
    params: QualityParams

    def judged(self, rows: DataFrame) -> DataFrame:
        """`rows` (host, path, own: log odds of the document model, and more) with p_document, p_host, p_path, probability, kept."""
        sites = self.sites
        if sites.count() <= SMALL_TABLE:
            sites = F.broadcast(sites)
        own = F.col("own")
        shift = F.lit(self.params.site_weight) * (_odds(F.col("p_path")) - _odds(F.lit(self.mean)))
        return (rows.join(sites, ["host", "path"], "left")
                .withColumn("p_document", _probability(own))
                .withColumn("probability", _probability(own + F.coalesce(shift, F.lit(0.0))))
                .withColumn("kept", F.col("probability") >= F.lit(self.params.threshold)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id",
                text_col: str = "text", params: QualityParams = QualityParams()) -> tuple[QualityModel, DataFrame]:
    """Fit on all of `docs`; also returns the judged rows (doc_id, host, path, own: log odds of the document).

    Defined cases: a null text is the empty text; a null host or path is the site ''; rows repeated count
    each time and are judged alike; an empty table fits a model that keeps everything.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = fit_document_model(texts, labels, params)
    with text_batches(docs.sparkSession):
        own = cut(_sites_of(docs.select(F.col(id_col).alias("doc_id"), host.alias("h"), path.alias("p"),
                                        model.log_odds(text_or_empty(text_col)).alias("own")),
                            F.col("h"), F.col("p")).select("doc_id", "host", "path", "own"))
    sites, mean = site_posteriors(own.select("host", "path", _probability(F.col("own")).alias("p")))
    return QualityModel(model, sites, mean, host, path, params), own


def classify(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """One row per input row: doc_id, host, path, p_document, p_host, p_path, probability, kept."""
    fitted, own = fit_quality(docs, labels, host=host, path=path, id_col=id_col, text_col=text_col, params=params)
    return fitted.judged(own).select("doc_id", "host", "path", "p_document", "p_host", "p_path",
                                       "probability", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id",
              text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of `docs` that the classifier keeps, all columns as they were. Rows are judged where they are read."""
    fitted, _ = fit_quality(docs, labels, host=host, path=path, id_col=id_col, text_col=text_col, params=params)
    rows = docs.select(F.struct("*").alias("rec"), host.alias("h"), path.alias("p"),
                       fitted.model.log_odds(text_or_empty(text_col)).alias("own"))
    return fitted.judged(_sites_of(rows, F.col("h"), F.col("p"))).where("kept").select("rec.*")
