"""Language identification with a string kernel.

Blended-spectrum presence kernel: two texts are as alike as the sets of their character
1- to 4-grams, |A & B| / sqrt(|A| |B|). Landmark texts from the training sample give a Nyström
map of that kernel; one-versus-rest kernel ridge regression on the map is folded into one
matrix, so scoring a batch is two matrix products over the landmarks' n-grams.

N-grams are told apart by 32 bits of hash; all n-grams of a text and of a landmark count.
The classifier is fitted on a bounded sample (TRAIN_ROWS rows at most, about as many of each
language) of the labelled rows outside the held-out fold. Landmarks are the sampled texts of a
language with the number of n-grams nearest LANDMARK_GRAMS; only their n-grams, and a row of
kernel values for each sampled text, come to the driver. Prediction reads the text alone.

Null texts and texts without a letter get ``und`` with score 0. An empty training set (or
table) predicts ``und`` for everything. Texts of any length are read whole, and rows that repeat
are judged alike; of languages that score the same the first by name wins. Extra columns of the
table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm import scratch

ORDERS = (1, 2, 3, 4)
TRAIN_ROWS = 1200
LANDMARKS = 96
LANDMARK_GRAMS = 2000
RIDGE = 1e-3
UND = "und"
HELD_OUT_FOLD, FOLDS = 2, 4
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """The sorted set of the hashes of the text's n-grams, in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = []
    for n in ORDERS:
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= points[k : len(points) - n + 1 + k]
            h *= _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        found.append(h * np.uint32(0x2C1B3C6D))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Landmarks:
    """Presence of every n-gram of the landmarks, and how many each landmark has."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([max(1, len(s)) for s in sets], np.float64)
        self.grams = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]))
        self.present = self.presence(sets)

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.grams)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(self.grams, s)
            at[at == len(self.grams)] = 0
            out[k, at[self.grams[at] == s]] = 1
        return out

    def kernel(self, texts: list[str]) -> np.ndarray:
        """A row of kernel values with all landmarks for each text."""
        out = np.zeros((len(texts), len(self.sizes)))
        for at in range(0, len(texts), 64) if len(self.grams) else ():
            sets = [ngrams(t) for t in texts[at : at + 64]]
            sizes = np.array([max(1, len(s)) for s in sets], np.float64)
            out[at : at + 64] = (self.presence(sets) @ self.present.T) / np.sqrt(sizes[:, None] * self.sizes[None, :])
        return out


class Model:
    """Landmarks, and a matrix from kernel values to scores of the languages."""

    def __init__(self, languages: list[str], landmarks: Landmarks, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        if at:
            raw = self.landmarks.kernel([texts[i] for i in at]) @ self.weights
            p = np.exp(4 * (raw - raw.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for k, i in enumerate(at):
                best = int(raw[k].argmax())
                names[i], scores[i] = self.languages[best], float(p[k, best])
        return names, scores


def solve(languages: list[str], rows: list[tuple[str, np.ndarray]], landmarks: Landmarks, ridge: float = RIDGE) -> Model:
    """Nyström map and one-versus-rest ridge weights from the sample's (language, kernel values)."""
    between = (landmarks.present @ landmarks.present.T) / np.sqrt(landmarks.sizes[:, None] * landmarks.sizes[None, :])
    values, vectors = np.linalg.eigh(between.astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    mapped = np.array([k for _, k in rows]) @ root
    own = np.array([languages.index(lang) for lang, _ in rows])
    target = np.where(np.arange(len(languages))[None, :] == own[:, None], 1.0, 0.0)
    # Rows of a rare language weigh as much together as those of a common one.
    weight = (1 / np.bincount(own, minlength=len(languages)))[own][:, None]
    solved = np.linalg.solve(mapped.T @ (mapped * weight) + ridge * np.eye(mapped.shape[1]), mapped.T @ (target * weight))
    return Model(languages, landmarks, root @ solved)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _sample(docs: DataFrame, rows: int, store: scratch.Scratch) -> DataFrame | None:
    """(lang, draw, text): a bounded sample of the labelled rows; the same for the same table."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)).cast("double") / (1 << 30)
    # A language with n rows is drawn at a rate that gives `each` on average; a tenth more, then cut.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.1 * each / n))]), F.col("lang"))
    drawn = labelled.where(draw < share).select("lang", draw.alias("draw"), "text").orderBy("draw", "lang", "text").limit(rows)
    return store.save(drawn, "sample")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Learn from doc_id, text and lang of the rows outside the held-out fold."""
    store = scratch.Scratch(docs.sparkSession, "langid")
    sample = _sample(docs, rows, store)
    if sample is None:
        return Model([], Landmarks([]), np.zeros((0, 0)))
    context = docs.sparkSession.sparkContext

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(ngrams(t)) for t in b.column(2).to_pylist()], pa.int64())], names=["lang", "draw", "n"])

    known = sample.mapInArrow(sizes, "lang string, draw double, n long").where("n > 0").orderBy("lang", "draw", "n").collect()
    languages = sorted({r["lang"] for r in known})
    if not languages:
        return Model([], Landmarks([]), np.zeros((0, 0)))
    each = max(1, landmarks // len(languages))
    chosen = {(r["lang"], r["draw"]) for want in languages for r in sorted((r for r in known if r["lang"] == want), key=lambda r: (abs(r["n"] - LANDMARK_GRAMS), r["draw"]))[:each]}

    def sets(batches):
        for b in batches:
            marks = [(lang, draw, ngrams(t).tobytes()) for lang, draw, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (lang, draw) in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in marks], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.binary()))], names=["lang", "draw", "grams"])

    found = sample.mapInArrow(sets, "lang string, draw double, grams binary").orderBy("lang", "draw", "grams").collect()
    marks = Landmarks([np.frombuffer(r["grams"], np.uint32) for r in found])
    shared = context.broadcast(marks)  # LANDMARKS sets

    def kernels(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(shared.value.kernel(b.column(2).to_pylist())), pa.list_(pa.float64()))], names=["lang", "draw", "kernel"])

    rows_ = sample.mapInArrow(kernels, "lang string, draw double, kernel array<double>").orderBy("lang", "draw", "kernel").collect()
    store.keep()
    return solve(languages, [(r["lang"], np.array(r["kernel"])) for r in rows_ if r["lang"] in languages], marks)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, which replace columns of these names."""
    scratch.bounded_batches(docs.sparkSession)
    kind = "struct<lang_pred:string,score:double>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS sets of n-grams

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, score(F.col(f"`{text}`")).alias("_lang")).select(*kept, "_lang.lang_pred", "_lang.score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    scratch.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
