"""Toxicity of whole texts: subword bags averaged into a linear softmax, trained jointly.

A text may hold one toxic word among thousands, which an average over the text would
drown.  The bag is therefore a word: its character n-grams share vectors with those of
other spellings of it.  The model learns from documents' labels in two rounds: first every
word stands for the labels of the documents that hold it, then each toxic document for
its most toxic word and the clean ones for theirs.  A text's score is a calibrated
function of its highest word scores, over all its words.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import labelled_sample, map_batches
from weftline.llm.subwords import Shape, bags, joined, logistic_fit, portions, train, word_scores

SHAPE = Shape(sizes=(3, 4, 5), buckets=1 << 17, digits=True)
#: Bounds of the sample: rows of a label, characters of a text; words learned from.
PER_LABEL, LONGEST, WORDS = 3000, 20_000, 100_000
THRESHOLD = 0.3
#: Misspellings learned with each word that is toxic in most of its documents.
SPELLINGS = 12
LEET = str.maketrans("aeiost", "431057")  # fixed values: digits for letters


@dataclass
class Model:
    scores: np.ndarray  # one number a bucket: toxic minus clean logit
    weights: np.ndarray  # of the document's features, bias last

    def predict(self, texts: list[str | None]) -> np.ndarray:
        seen = np.concatenate([features(part, self.scores) for part in portions(texts)])
        return 1 / (1 + np.exp(-np.clip(np.column_stack([seen, np.ones(len(texts))]) @ self.weights, -30, 30)))


def features(texts: list[str | None], scores: np.ndarray) -> np.ndarray:
    """Per text: its highest word score, and its second highest; a text without words has the lowest."""
    word, _, _, cuts = word_scores(texts, scores, SHAPE)
    low = -20.0
    out = np.full((len(texts), 2), low)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b - a > 1:
            out[i] = np.partition(word[a:b], -2)[-2:][::-1]
        elif b > a:
            out[i, 0] = word[a]
    return np.clip(out, low, 20)


def _words(texts: list[str]) -> list[set[bytes]]:
    table = SHAPE
    return [{w for w in set(joined([t], table)[0].tobytes().split()) if not w.isdigit()} for t in texts]


def misspelt(word: bytes, rng: np.random.Generator, times: int) -> list[bytes]:
    """Spellings of a word with one character left out, doubled, swapped or put as a digit."""
    text, out = word.decode("utf-8", "replace"), []
    for _ in range(times):
        i, kind = int(rng.integers(len(text))), int(rng.integers(4))
        if kind == 0:
            other = text[:i] + text[i + 1 :]
        elif kind == 1:
            other = text[: i + 1] + text[i:]
        elif kind == 2:
            other = text[:i] + text[i : i + 2][::-1] + text[i + 2 :]
        else:
            other = text[:i] + text[i].translate(LEET) + text[i + 1 :]
        out.append(other.encode())
    return out


def _learn(words: list[bytes], toxic: np.ndarray, weight: np.ndarray, epochs: int) -> np.ndarray:
    shown = [w.decode("utf-8", "replace") for w in words]
    table = train(bags(shown, SHAPE), np.column_stack([1 - toxic, toxic]), weight, SHAPE, epochs=epochs, batch=128)
    return (table[:, 1] - table[:, 0]).astype(np.float32)


def fit(rows: DataFrame, labels: DataFrame | None = None, per_label: int = PER_LABEL) -> Model | None:
    """A model from ``rows`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1); None without both labels.

    Without ``labels`` the rows have ``toxic`` themselves.
    """
    sample = labelled_sample(rows, "toxic", "text", per_label, 2, LONGEST, labels)
    y = sample["label"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    texts, stands_for = sample["text"].tolist(), sample["weight"].to_numpy(float)
    held = np.arange(len(y)) % 4 == 3
    learn = np.flatnonzero(~held)
    counts: dict[bytes, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for i, found in zip(learn, _words([texts[i] for i in learn])):
        for w in found:
            counts[w][int(y[i])] += 1
    share = y[learn].mean()
    odds = (1 - share) / share
    # The words that tell most: those in the most documents, and all are counted before.
    chosen = sorted(counts, key=lambda w: (-sum(counts[w]), w))[:WORDS]
    pro = np.array([counts[w][1] * odds for w in chosen])
    con = np.array([counts[w][0] for w in chosen])
    toxic = (pro + 0.5) / (pro + con + 2)  # few documents tell little
    scores = _learn(chosen, toxic, np.minimum(8.0, np.sqrt(pro + con)), epochs=4)

    hardest: dict[bytes, list[float]] = defaultdict(lambda: [0.0, 0.0])
    part = [texts[i] for i in learn]
    for at in range(0, len(part), 256):
        block = part[at : at + 256]
        raw, _ = joined(block, SHAPE)
        word, first, last, cuts = word_scores(block, scores, SHAPE)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            label = int(y[learn[at + i]])
            for k in (np.argsort(word[a:b])[::-1][: 2 if label else 4]) + a:
                hardest[raw[first[k] : last[k]].tobytes()][label] += 1
    words = sorted(hardest)
    pro = np.array([hardest[w][1] * odds for w in words])
    con = np.array([hardest[w][0] for w in words])
    plain = [w for w in chosen if counts[w][1] * odds <= counts[w][0] and w not in hardest][: WORDS // 4]
    toxic = np.concatenate([pro / (pro + con + 1), np.zeros(len(plain))])
    weight = np.concatenate([np.minimum(8.0, np.sqrt(pro + con)), np.ones(len(plain))])
    rng = np.random.default_rng(11)
    other = [(v, t) for w, t, n in zip(words, toxic, pro) if t > 0.8 and n >= 4 and len(w) > 3 for v in misspelt(w, rng, SPELLINGS) if v not in counts]
    words, toxic = words + plain + [v for v, _ in other], np.concatenate([toxic, [t for _, t in other]])
    scores = _learn(words, toxic, np.concatenate([weight, np.ones(len(other))]), epochs=6)

    at = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    weights = logistic_fit(features([texts[i] for i in at], scores), y[at], stands_for[at])
    return Model(scores, weights)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at or above ``threshold``), from ``text`` alone.

    A null or empty text is scored like one without words; without a model all score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    text = names.index("text")
    out = docs.select(*names)

    def work(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            values = np.zeros(len(texts)) if model is None else model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    return map_batches(out, work, out.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)

