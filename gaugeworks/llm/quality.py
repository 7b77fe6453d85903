"""Quality classifier: document evidence combined with hierarchical empirical Bayes site priors.

1. A logistic regression over the most telling hashed words and a few shape features of the whole
   text, fitted on a bounded sample of labelled rows.
2. Its evidence and all labels are summed by host and by path (host and one more level). The share
   of good documents of each host is shrunk toward the global share, that of each path toward
   its host's, by as much as the spread of the shares asks for (method of moments), so that
   sparse sites stay near their prior.
3. A document's log odds are the classifier's, moved by how far its path's posterior lies from
   the global share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import wordhash
from gaugeworks.llm.common import others, slices, small, stored, table, text_bytes

BINS = 1 << 20
#: Parameters of the model: how many word bins a target may weigh at most, the most unevenly spread over its classes, from this z score on.
#: All bins of all labelled texts in the sample are counted to choose them.
WORDS_USED, WORDS_Z = 256, 5.0
#: Most labelled rows that the classifier is fitted on, and most bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 64_000_000
#: Most sites whose posteriors are broadcast; beyond it documents meet them in a salted join.
BROADCAST_SITES = 200_000
SALTS = 64
SHAPE = ("log words", "mean word length", "distinct share", "upper share", "symbol share", "digit share", "line repeats")


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Shape features of each text, and its distinct word bins with their damped counts."""
    h, n = wordhash.words(data, offsets)
    ends = np.cumsum(n)
    size = np.diff(offsets)
    total = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[data])))[offsets])
    many = np.maximum(size, 1)
    upper, digit, symbol = (total(t) / many for t in (_UPPER, _DIGIT, _SYMBOL))
    shape = np.zeros((len(n), len(SHAPE)))
    bins = []
    for i, (end, k) in enumerate(zip(ends, n)):
        own = h[end - k : end]
        kinds, counts = np.unique(own, return_counts=True)
        bins.append(((kinds & np.uint64(BINS - 1)).astype(np.int32), np.log1p(counts).astype(np.float32)))
        pairs = own[1:] * np.uint64(3) + own[:-1]
        shape[i] = (np.log1p(k) / 5, min(size[i] / max(k, 1), 30) / 10, len(kinds) / max(k, 1), upper[i] * 3, min(symbol[i] * 8, 3), min(digit[i] * 8, 3), 1 - len(np.unique(pairs)) / max(len(pairs), 1))
    return shape, bins


@dataclass(frozen=True)
class Classifier:
    """Weights of the shape features, of the word bins, and the intercept; for each of several targets."""

    shape: np.ndarray
    words: np.ndarray
    bias: np.ndarray

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """rows x targets; whole texts, null as empty."""
        out = []
        for shape, bins in _sliced(texts):
            words = np.array([values @ self.words[at] for at, values in bins])
            out.append(shape @ self.shape + words + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)))


def _sliced(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """_features of some texts at a time."""
    data, offsets = text_bytes(texts)
    for a, b in slices(np.diff(offsets), most):
        yield _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fit(texts: list[str], targets: np.ndarray) -> Classifier:
    """Fits on texts at hand."""
    got = [(s, a, v) for shape, bins in _sliced(pa.array(texts, pa.string())) for s, (a, v) in zip(shape, bins)]
    shape = np.array([s for s, _, _ in got]).reshape(-1, len(SHAPE))
    return fit_features(shape, np.array([len(a) for _, a, _ in got], np.int64), *(np.concatenate([np.zeros(0, kind), *(g[i] for g in got)]) for i, kind in ((1, np.int32), (2, np.float32))), targets)


def fit_features(shape: np.ndarray, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, targets: np.ndarray, steps: int = 300, decay: float = 1e-4) -> Classifier:
    """Logistic regression by gradient descent with momentum over all given rows, on the driver.

    shape: a row for each text; sizes: how many entries of at (word bins) and values each text has.
    A target with one class only keeps its log share: no text then moves it.
    """
    n, k = targets.shape
    share = (targets.sum(0) + 1) / (n + 2)
    bias = np.log(share / (1 - share))
    rows = np.repeat(np.arange(n, dtype=np.int32), sizes)
    fitted_shape, fitted_words = np.zeros((len(SHAPE), k)), np.zeros((BINS, k), np.float32)
    held = np.bincount(at, minlength=BINS)
    for j in range(k):
        y = targets[:, j].astype(float)
        if not n or y.min() == y.max():
            continue
        p = y.mean()
        z = np.abs(np.bincount(at, y[rows], BINS) - held * p) / np.sqrt(np.maximum(held, 1) * p * (1 - p))
        used = np.argsort(-z, kind="stable")[:WORDS_USED]
        used = used[z[used] >= WORDS_Z]
        place = np.full(BINS, -1)
        place[used] = np.arange(len(used))
        own = np.isin(at, used)
        x = np.zeros((n, len(SHAPE) + len(used)))
        x[:, : len(SHAPE)] = shape
        np.add.at(x, (rows[own], len(SHAPE) + place[at[own]]), values[own])
        w, b, m, v = np.zeros(x.shape[1]), bias[j], np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, steps + 1):
            g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / n
            grad = np.append(x.T @ g + decay * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        fitted_shape[:, j], fitted_words[used, j], bias[j] = w[: len(SHAPE)], w[len(SHAPE) :], b
    return Classifier(fitted_shape, fitted_words, bias)


def fit_on_labels(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Classifier:
    """Fits on at most ``rows`` labelled documents of at most ``size`` bytes together, those whose id's hash is smallest.

    targets: 0/1 columns over labels. Labels that are null, and ids that are null, are left out. Of several labels of one id the greatest of
    each target counts, of several texts of one id the greatest; so an id is one row, and the model is the same whatever the order of rows.
    """
    marks = [f"t_{name}" for name in targets]
    wanted = labels.select(F.col(id).alias("id_"), *(c.cast("int").alias(f"t_{name}") for name, c in targets.items())).dropna()
    wanted = wanted.groupBy("id_").agg(*(F.max(m).alias(m) for m in marks)).orderBy(F.xxhash64("id_"), "id_").limit(rows)
    met = docs.select(docs[id].alias("id_"), docs[text].cast("string").alias("__text")).join(F.broadcast(wanted), "id_")
    once = stored(met.groupBy("id_").agg(*(F.first(m).alias(m) for m in marks), F.max("__text").alias("__text")), "quality-sample")
    upto = F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(Window.orderBy(F.xxhash64("id_"), "id_").rowsBetween(Window.unboundedPreceding, 0))
    small_enough = once.select("id_", upto.alias("upto")).filter(F.col("upto") <= size).select("id_")  # at most ``rows`` ids
    found = once.join(F.broadcast(small_enough), "id_", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for shape, bins in _sliced(batch.column(len(marks))):
                some = batch.slice(at, len(bins))
                at += len(bins)
                lists = [pa.array(list(shape), pa.list_(pa.float64())), pa.array([a for a, _ in bins], pa.list_(pa.int32())), pa.array([v for _, v in bins], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(marks)], *lists], [*marks, "shape", "at", "values"])

    # Features are made where the texts lie; the driver gets those of at most ``rows`` texts.
    told = found.select(*marks, "__text").mapInArrow(run, ", ".join([*(f"{m} int" for m in marks), "shape array<double>, at array<int>, values array<float>"])).toArrow().combine_chunks()
    flat = lambda name: told[name].combine_chunks().flatten().to_numpy() if told.num_rows else np.zeros(0)
    sizes = np.array([len(x) for x in told["at"]], np.int64)
    y = np.column_stack([told[m].to_numpy() for m in marks]) if told.num_rows else np.zeros((0, len(marks)))
    return fit_features(flat("shape").reshape(-1, len(SHAPE)), sizes, flat("at").astype(np.int32), flat("values"), y)


def with_log_odds(docs: DataFrame, model: Classifier, names: list[str], text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` and the columns e_<name>: the classifier's log odds from the whole text."""
    kept = others(docs, [f"e_{n}" for n in names] + [text] * drop_text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*kept, docs[text].cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(f"e_{n}", T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.value.log_odds(batch.column(batch.num_columns - 1))
            made = [pa.array(np.ascontiguousarray(odds[:, j])) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema.names)

    return source.mapInArrow(run, schema)


def _share(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(evidence: DataFrame, host: str, path: str) -> DataFrame:
    """host, path, host_posterior, path_posterior, __global_share.

    evidence: rows with __host, __path and __good (a share from 0 to 1). Sums are pre-aggregated by
    path. The prior of a level weighs as many documents as m = p (1 - p) / var - 1 says, where var is
    the spread of its shares beyond that of chance; from 2 to 10,000.
    """
    paths = stored(evidence.groupBy("__host", "__path").agg(F.sum("__good").alias("k"), F.count("*").alias("n")), "quality-sites")
    hosts = paths.groupBy("__host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    good, rows = hosts.agg(F.coalesce(F.sum("hk"), F.lit(0.0)), F.coalesce(F.sum("hn"), F.lit(0))).first()
    share = (good + 1) / (rows + 2)
    spread = lambda k, n, p: F.sum(F.col(n) * (F.col(k) / F.col(n) - p) ** 2 - p * (1 - p)) / F.sum(n)
    weight = _weight(share, hosts.agg(spread("hk", "hn", F.lit(share))).first()[0])
    ranked = hosts.select(F.col("__host").alias("__h"), ((F.col("hk") + weight * share) / (F.col("hn") + weight)).alias("host_posterior"))
    joined = paths.join(ranked, F.expr("__host <=> __h")).drop("__h")
    weight = _weight(share, joined.agg(spread("k", "n", F.col("host_posterior"))).first()[0])
    posterior = (F.col("k") + weight * F.col("host_posterior")) / (F.col("n") + weight)
    return joined.select("__host", "__path", "host_posterior", posterior.alias("path_posterior"), F.lit(share).alias("__global_share"), F.col("n").alias("__site_rows"))


def _weight(share: float, spread: float | None) -> float:
    return 2.0 if spread is None else min(10_000.0, max(2.0, share * (1 - share) / max(spread, 1e-6) - 1))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id: str = "doc_id", text: str = "text", threshold: float = 0.5, toxic_threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with e_good, host_posterior, path_posterior, p_good, p_toxic and accepted.

    labels: id, quality and toxic (0 or 1). accepted: p_good of at least ``threshold`` and p_toxic,
    from the document alone, of at most ``toxic_threshold``. Nulls: a null text counts as empty, a null
    host or path as a site of its own; columns of ``docs`` named like a new one give way; null labels are no labels. Without labels every document
    has even odds and is accepted. Repeated rows are scored each. The text isn't shuffled, but that of the sample.

    Parameters of the model: it is fitted on a sample of labelled rows (SAMPLE_ROWS, SAMPLE_BYTES); a target weighs at most WORDS_USED word bins, those
    most unevenly spread over its classes, from a z score of WORDS_Z on; a site's prior weighs as 2 to 10,000 documents.
    """
    made = ("e_good", "e_toxic", "host_posterior", "path_posterior", "p_good", "p_toxic", "accepted")
    docs = docs.select(*others(docs, made))
    model = fit_on_labels(docs, labels, {"good": F.col("quality"), "toxic": F.col("toxic")}, id, text)
    names = ["good", "toxic"]
    # Stored, so that features are made once: posteriors need all log odds before any row is scored.
    scored = stored(with_log_odds(docs, model, names, text, drop_text=not keep_text), "quality-scored")
    one = scored.select(*dict.fromkeys((id, host, path)), "e_good")
    known = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id_")).agg(F.max("quality").alias("__label"))
    told = one.join(known, one[id] == known["id_"], "left")
    evidence = told.select(F.col(host).alias("__host"), F.col(path).alias("__path"), F.coalesce(F.col("__label").cast("double"), _share(F.col("e_good"))).alias("__good"))
    sites = stored(site_posteriors(evidence, host, path), "quality-posteriors")
    on = F.expr(f"`{host}` <=> __host and `{path}` <=> __path")
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        met = scored.join(F.broadcast(sites), on, "left")
    else:
        salted = sites.withColumn("__salt_at", F.explode(F.when(F.col("__site_rows") > 100_000, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        hot = small(sites.filter(F.col("__site_rows") > 100_000).select(F.col("__host").alias("__hot_h"), F.col("__path").alias("__hot_p")), 10**6)
        marked = scored.join(hot, F.expr(f"`{host}` <=> __hot_h and `{path}` <=> __hot_p"), "left")
        salt = F.when(F.col("__hot_p").isNotNull() | F.col("__hot_h").isNotNull(), F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        met = marked.withColumn("__salt", salt).drop("__hot_h", "__hot_p").join(salted, on & F.expr("__salt = __salt_at"), "left").drop("__salt", "__salt_at")
    p_good = _share(F.col("e_good") + _logit(F.col("path_posterior")) - _logit(F.col("__global_share")))
    out = met.withColumn("p_good", p_good).withColumn("p_toxic", _share(F.col("e_toxic")))
    out = out.withColumn("accepted", (F.col("p_good") >= threshold) & (F.col("p_toxic") <= toxic_threshold))
    columns = [c for c in docs.columns if keep_text or c != text]
    return out.select(*columns, "e_good", "host_posterior", "path_posterior", "p_good", "p_toxic", "accepted")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", F.round("e_good", 6).alias("doc_log_odds"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), F.round("p_good", 6).alias("p_good"), F.round("p_toxic", 6).alias("p_toxic"), "accepted")
