"""Operator 9: language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit, a logistic classifier on hashed byte n-grams learns to tell the
languages with a one from those with a zero. A text gets the language whose codeword costs the least, where
each bit's loss weighs as much as the bit can be trusted for that language; close calls are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.plans.session import small_batches

UNKNOWN = "und"
DIMENSIONS = 4096
SAMPLE = 6000  # labelled documents that the classifiers are fitted on, at most
PER_LANGUAGE = 1000
MARGIN = 0.1  # least lead in probability of a call that isn't ambiguous
CHUNK = 1 << 18

# byte classes: letters A-Z as a-z, other ASCII than letters as a blank, bytes of longer characters as they are
_FOLD = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1: all splits of the languages for up to 7, else the best of some random codes."""
    if k <= 7:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 1 << (k - 1))] for i in range(k)], np.float32).reshape(k, -1)
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k))))).astype(np.float32)
        apart = code.shape[1] - code @ code.T + 2 * code.shape[1] * np.eye(k)
        if apart.min() > most and (np.abs(code.sum(0)) < k).all():
            best, most = code, apart.min()
    return best


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that end at each byte but the first two."""
    a, b, c = data[:-2].astype(np.uint32), data[1:-1].astype(np.uint32), data[2:].astype(np.uint32)
    mix = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    return [mix(c + np.uint32(1)), mix((b << np.uint32(8)) + c + np.uint32(1 << 17)), mix((a << np.uint32(16)) + (b << np.uint32(8)) + c + np.uint32(1 << 25))]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of DIMENSIONS for each text: square roots of n-gram counts, scaled to length 1. Depends on that text alone."""
    counts = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        folded = (text or "").lower().encode("utf-8", "replace").translate(_FOLD)
        for at in range(0, max(len(folded), 1), CHUNK):
            # a long text is counted in pieces, with the two bytes before each
            piece = b"  " + folded[:CHUNK] if at == 0 else folded[at - 2 : at + CHUNK]
            data = np.frombuffer(piece, np.uint8)
            if len(data) > 2:
                counts[i] += np.bincount(np.concatenate(_grams(data)), minlength=DIMENSIONS)
    counts[:, _grams(np.full(3, 32, np.uint8))[2][0]] = 0  # runs of blanks say nothing
    rows = np.sqrt(counts)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # of n-grams, by bit
    bias: np.ndarray
    trust: np.ndarray  # of bits, by language

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, from its codeword's weighted loss."""
        if self.code.shape[1] == 0:
            return np.ones((len(x), len(self.languages)))
        out = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.stack([(np.logaddexp(0, -out * row) * t).sum(1) for row, t in zip(self.code, self.trust, strict=True)], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: list[str], rounds: int = 80, penalty: float = 1e-5) -> Model:
    """Logistic regressions for all bits at once, by accelerated gradient steps; classes weigh the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = np.array([languages.index(v) for v in labels])
    y = code[place]
    weight = (1 / np.bincount(place))[place][:, None].astype(np.float32) / len(languages)
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    last, last_bias, step = w, bias, 16.0
    for i in range(rounds if code.shape[1] else 0):
        ahead, ahead_bias = w + (w - last) * (i / (i + 3)), bias + (bias - last_bias) * (i / (i + 3))
        slope = -y * weight / (1 + np.exp(np.clip(y * (x @ ahead + ahead_bias), -30, 30)))
        last, last_bias = w, bias
        w, bias = ahead - step * (x.T @ slope + penalty * ahead), ahead_bias - step * 0.1 * slope.sum(0)
    right = (np.sign(x @ w + bias) == y).astype(np.float64)
    trust = np.stack([right[place == k].mean(0) for k in range(len(languages))])
    trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9) * code.shape[1]
    return Model(languages, code, w.astype(np.float32), bias.astype(np.float32), trust)


def held_out(id_col: str = "doc_id"):
    """Documents never learned from: crc32 of the id's digits, modulo 3, is 1. A null id counts as learned from never, held out not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model | None:
    """Fit on a sample of (doc_id, text, lang): at most PER_LANGUAGE of each language and SAMPLE in all, spread by hash.

    Counts of labels cover all documents; the sample's features, 8 KB each, come to the driver. None if there is no label.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    quota = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * quota / n))) for lang, n in counts.items()])
    spread = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = features(part.column(0).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "spread", "x"])

    sample = usable.withColumn("spread", spread).where(F.col("spread") < share * (1 << 30)).select("text", "lang", "spread")
    rows = sample.mapInArrow(run, "lang string, spread long, x binary").collect()
    x, labels = [], []
    for lang in sorted(counts):
        own = sorted((r["spread"], r["x"]) for r in rows if r["lang"] == lang)[:quota]
        x += [np.frombuffer(v, np.float16) for _, v in own]
        labels += [lang] * len(own)
    return fit(np.stack(x).astype(np.float32), labels) if x else None


def lettered(text: str | None) -> bool:
    """Does the text hold a letter? Numbers that are written with letters (½, Ⅷ, ①) are none."""
    return bool(text) and any(map(str.isalpha, text))


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether the call is ambiguous, for each text."""
    known = list(map(lettered, texts))
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    p = model.probabilities(features(texts))
    best = p.argmax(1)
    score = p[np.arange(len(p)), best]
    lead = score - np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else score
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
    return names, [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)], [not k or bool(d < MARGIN) for d, k in zip(lead, known, strict=True)]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for (doc_id, text); only the text decides.

    Null, empty and letterless texts are ``und`` with score 0. Every row is judged on its own, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, scores, close = predict(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns: those with letters and a score of ``least`` or more.

    With four languages a call that says nothing scores 0.25; clean prose scores close to 1. Null, empty and letterless texts
    go; repeated rows are judged each on its own; other columns, null or not, do not matter. Where nothing can be learned, as
    no row has a label, every text with letters stays. An empty table gives an empty result.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = part.column(at).to_pylist()
                if model is None:
                    yield part.filter(pa.array(list(map(lettered, texts)), pa.bool_()))
                    continue
                names, scores, _ = predict(texts, model)
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
