"""Language identification with a byte convolutional network.

Filters over two, three and four neighbouring bytes of a window, the largest
response of each filter in the window, and a softmax over the languages. The
network is trained in NumPy on the driver, from windows of a bounded sample of
labelled documents: at most ``TRAIN_DOCS`` of them in equal parts by language,
those with the smallest hashes of their ids, and ``PER_DOC`` windows of each. It
is then applied to every fixed-length window of every whole text; a document's
score for a language is the mean over its windows, weighted by their bytes.

Texts that are null or have no letter are ``und`` with score 0, and so is every
text when there is no labelled row. Null ids are not learned from and not held
out; rows with equal ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import query, table, text_batches, utf8

WINDOW = 256
DIM, REACH = 8, 4
FILTERS = {2: 8, 3: 16, 4: 24}
TRAIN_DOCS, PER_DOC, SAMPLE_CHARS = 4000, 2, 300
SHORTEST = 24  # bytes of a training window, which are cut at random to learn short texts, too
EPOCHS, BATCH, RATE = 4, 32, 0.01
SALTS = 16
UNKNOWN = "und"
RESULT = "key long, lang_pred string, score double"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, DIM); byte 0 pads
    filters: np.ndarray  # (REACH * DIM, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter and where it is; windows: (n, WINDOW) bytes."""
        cells = self.embed[windows].reshape(len(windows), -1)
        places = windows.shape[1] - REACH + 1
        step = cells.strides[1]
        patches = np.lib.stride_tricks.as_strided(
            cells, (len(windows), places, REACH * DIM), (cells.strides[0], DIM * step, step)
        )
        responses = (patches.reshape(-1, REACH * DIM) @ self.filters).reshape(len(windows), places, -1)
        where = responses.argmax(axis=1) if self.training else None
        return np.maximum(responses.max(axis=1) + self.bias, 0), where

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled, _ = self.pooled(windows)
        return _softmax(pooled @ self.out + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fold(text: str) -> bytes:
    return utf8(text.lower())


def cut_windows(data: bytes) -> np.ndarray:
    """The text's windows; the last one is padded."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """A network from labelled texts, by Adam on the cross-entropy of their windows."""
    languages = sorted(set(labels))
    random = np.random.default_rng(seed)
    mask = np.concatenate(
        [np.repeat((np.arange(REACH) < width).astype("f4"), DIM)[:, None].repeat(n, 1) for width, n in FILTERS.items()], 1
    )
    n = mask.shape[1]
    net = Network(
        languages,
        random.normal(0, 0.5, (256, DIM)).astype("f4"),
        (random.normal(0, 0.2, (REACH * DIM, n)) * mask).astype("f4"),
        np.zeros(n, "f4"),
        random.normal(0, 0.2, (n, len(languages))).astype("f4"),
        np.zeros(len(languages), "f4"),
    )
    net.training = True
    windows = [cut_windows(fold(t)[:WINDOW]) for t in texts]
    x, y = np.concatenate(windows), np.array([languages.index(v) for v in labels])
    cut = np.exp(random.uniform(np.log(SHORTEST), np.log(2 * WINDOW), len(x)))
    x[np.arange(WINDOW) >= cut[:, None]] = 0
    names = ["embed", "filters", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, steps = 0, EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(x))
        for at in range(0, len(x), BATCH):
            step += 1
            for k, g in _gradients(net, x[order[at : at + BATCH]], y[order[at : at + BATCH]], mask).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                value = getattr(net, k)
                value -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype("f4")
    net.training = False
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    pooled, where = net.pooled(x)
    error = _softmax(pooled @ net.out + net.out_bias)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = (error @ net.out.T) * (pooled > 0)  # (batch, filters)
    embed, filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
    rows = np.arange(len(x))[:, None]
    for j in range(REACH):  # only the byte runs with the largest responses move
        part = slice(j * DIM, (j + 1) * DIM)
        byte = x[rows, where + j]
        filters[part] = np.einsum("bfd,bf->df", net.embed[byte], back)
        np.add.at(embed, byte.ravel(), (back[:, :, None] * net.filters[part].T[None]).reshape(-1, DIM))
    return {
        "embed": embed,
        "filters": filters * mask,
        "bias": back.sum(axis=0),
        "out": pooled.T @ error,
        "out_bias": error.sum(axis=0),
    }


# --- on documents -----------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Windows of a bounded number of labelled documents, and their languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    languages = known.select("lang").distinct().count()
    if not languages:
        return [], []
    share = max(1, most // languages // SALTS)
    drawn = known.withColumn("draw", F.xxhash64(F.lit("train"), F.col("doc_id")))
    drawn = drawn.withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    last = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    cuts = [
        F.substring("text", (F.pmod(F.xxhash64("draw", F.lit(i)), last) + 1).cast("int"), F.lit(SAMPLE_CHARS))
        for i in range(PER_DOC)
    ]
    small = drawn.select("doc_id", "lang", "draw", "salt", F.array(*cuts).alias("cuts"))
    order = Window.partitionBy("lang", "salt").orderBy("draw", "doc_id", "cuts")
    rows = small.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share).collect()
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["cuts"]))
    pairs = [(cut, r["lang"]) for r in rows for cut in r["cuts"] if any(map(str.isalpha, cut))]
    return [c for c, _ in pairs], [lang for _, lang in pairs]


def net_scores(net: Network | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language of each text and its score."""
    spoken = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
    language, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if spoken:
        data = [fold(texts[i]) for i in spoken]
        windows = np.concatenate([cut_windows(d) for d in data])
        found = np.concatenate([net.probabilities(windows[a : a + 256]) for a in range(0, len(windows), 256)])
        counts = np.array([max(1, -(-len(d) // WINDOW)) for d in data])
        found = found.astype(float) * np.maximum(1, np.count_nonzero(windows, axis=1))[:, None]
        sums = np.add.reduceat(found, np.cumsum(counts) - counts)
        sums /= sums.sum(axis=1, keepdims=True)
        for i, row in zip(spoken, sums):
            language[i], score[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
    return language, score


def _apply(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 1_000_000):
            language, score = net_scores(net, texts)
            columns = [batch.column("key"), pa.array(language, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score"])

    return run


def fit(docs: DataFrame) -> Network | None:
    texts, labels = sample(docs)
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, key: str, net: Network | None) -> DataFrame:
    """key, lang_pred and score of each row's whole text."""
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(_apply(net), RESULT)


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = identify(docs, "doc_id", fit(docs)).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


MIN_SCORE = 0.25


def drop_unknown_language(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: letters, and a score of ``least`` or more."""
    net = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 1_000_000):
            language, score = net_scores(net, texts)
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(language, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
