"""Language of whole texts: averaged hashed subword embeddings with a linear softmax.

Trained by stochastic gradient descent on a bounded sample of labelled rows; a quarter of
the sample fits the temperature of the softmax and the rejection threshold, the rest the
embeddings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import labelled_sample, map_batches
from weftline.llm.subwords import Shape, bags, portions, softmax, text_logits, train

UNKNOWN = "und"
SHAPE = Shape(sizes=(3, 4), buckets=1 << 15, digits=False)
#: Bounds of the sample: rows of a language, languages, characters of a text.
PER_LANGUAGE, LANGUAGES, LONGEST = 500, 200, 20_000
#: The share of rightly named calibration texts that rejection may lose.
LOST_SHARE = 0.001
#: No text named with more certainty than this is rejected.
SURE = 0.5


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; digits, fractions and letter-like numbers are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = [text_logits(part, self.table, SHAPE) for part in portions(texts)]
        logits, count = (np.concatenate(x) for x in zip(*parts))
        p = softmax(logits * self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[b] if has_letter(t) else UNKNOWN for t, b in zip(texts, best)]
        score = np.where([n == UNKNOWN for n in names], 0.0, np.where(count > 0, p.max(axis=1), 1 / len(self.languages)))
        return names, score


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from labelled ``rows`` (doc_id, text, lang); None if there are none."""
    sample = labelled_sample(rows.select("doc_id", "text", "lang"), "lang", "text", per_language, LANGUAGES, LONGEST)
    sample = sample[sample["text"].map(has_letter)]
    if sample.empty:
        return None
    languages = sorted(sample["label"].unique())
    y = np.array([languages.index(v) for v in sample["label"]])
    held = np.arange(len(y)) % 4 == 3
    texts = sample["text"].tolist()
    learn = [t for t, h in zip(texts, held) if not h]
    table = train(bags(learn, SHAPE), np.eye(len(languages))[y[~held]], np.ones(len(learn)), SHAPE, epochs=8)
    checked = [t for t, h in zip(texts, held) if h] or learn
    truth = y[held] if held.any() else y
    logits, _ = text_logits(checked, table, SHAPE)
    trials = [(-np.log(softmax(logits * t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in 2.0 ** np.arange(-3, 7, 0.25)]
    temperature = min(trials)[1]
    p = softmax(logits * temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    threshold = min(SURE, float(right[int(LOST_SHARE * len(right))])) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), float(temperature), threshold)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, from ``text`` alone.

    A text that is null, empty or without a letter is ``und`` with score 0 and rejected; so
    is every text without a model.  Others get the likeliest learned language, and are
    rejected if their calibrated score lies below the model's threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    text = names.index("text")
    out = docs.select(*names)

    def work(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if model is None:
                found, score, limit = [UNKNOWN] * len(texts), np.zeros(len(texts)), 1.0
            else:
                (found, score), limit = model.predict(texts), model.threshold
            rejected = [n == UNKNOWN or s < limit for n, s in zip(found, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*names, "lang_pred", "score", "rejected"],
            )

    schema = out.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return map_batches(out, work, schema)
