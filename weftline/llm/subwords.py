"""Hashed subword embeddings with a linear softmax, in numpy.

A text is its character n-grams inside words, hashed to buckets.  The model averages the
embeddings of a bag's buckets and puts a linear softmax on the average; embeddings and
softmax are trained together by stochastic gradient descent.  Since all of it is linear up
to the softmax, a trained model is one table of buckets by classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = 32


def alphabet(digits: bool) -> bytes:
    """Bytes of words: small letters for A-Z, all non-ASCII, digits on demand; others part words."""
    return bytes(
        b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or (digits and 48 <= b <= 57) else BLANK
        for b in range(256)
    )


@dataclass(frozen=True)
class Shape:
    """What a bag is made of: n-gram lengths in bytes, buckets, whether digits are letters."""

    sizes: tuple[int, ...]
    buckets: int  # a power of two
    digits: bool
    dim: int = 16


def portions(texts: list[str | None], chars: int = 1 << 19) -> list[list[str | None]]:
    """``texts`` in runs of bounded size, for the arrays made of them; a long text is one by itself."""
    out, size = [[]], 0
    for t in texts:
        n = len(t or "")
        if out[-1] and size + n > chars:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


def joined(texts: list[str | None], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in one array of bytes, blanks between, and where each text begins."""
    table = alphabet(shape.digits)
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(table) for t in texts]
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8), starts


def ngrams(raw: np.ndarray, shape: Shape):
    """(place of the second byte, bucket) of the n-grams of each length; word borders count as bytes."""
    solid = raw != BLANK
    wide = raw.astype(np.uint32)
    for size in shape.sizes:
        n = len(raw) - size + 1
        if n <= 0:
            continue
        inside = solid[1 : 1 + n].copy()
        for k in range(2, size - 1):
            inside &= solid[k : k + n]
        at = np.flatnonzero(inside)
        key = np.full(len(at), size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            key = (key ^ wide[at + k]) * np.uint32(0x01000193)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(13)
        yield at + 1, (key & np.uint32(shape.buckets - 1)).astype(np.int64)


def bags(texts: list[str], shape: Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its buckets, and the share of its n-grams that falls to each."""
    raw, starts = joined(texts, shape)
    found = list(ngrams(raw, shape))
    place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    bucket = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
    text = np.searchsorted(starts, place, "right") - 1
    keys, counts = np.unique(text * shape.buckets + bucket, return_counts=True)
    owner = keys // shape.buckets
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        share = counts[a:b].astype(np.float32)
        out.append((keys[a:b] % shape.buckets, share / max(1.0, share.sum())))
    return out


def train(bag: list, target: np.ndarray, weight: np.ndarray, shape: Shape, epochs: int, rate: float = 0.5, batch: int = 64, seed: int = 7) -> np.ndarray:
    """Bucket-by-class table after SGD on soft ``target`` (rows by classes).

    Steps are divided by the root of the squared gradients seen so far (one number for
    each bucket and each class), so that rare buckets learn as frequent ones do.
    """
    rng = np.random.default_rng(seed)
    classes = target.shape[1]
    embed = rng.normal(0, 0.1, (shape.buckets, shape.dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (shape.dim, classes)).astype(np.float32)
    seen_embed = np.full(shape.buckets, 1e-6, np.float32)
    seen_soft = np.full(classes, 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bag))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = [len(bag[r][0]) for r in rows]
            buckets = np.concatenate([bag[r][0] for r in rows])
            share = np.concatenate([bag[r][1] for r in rows])
            if not len(buckets):
                continue
            used, local = np.unique(buckets, return_inverse=True)
            mix = np.zeros((len(rows), len(used)), np.float32)
            mix[np.repeat(np.arange(len(rows)), sizes), local] = share
            part = embed[used]
            hidden = mix @ part
            logits = hidden @ soft
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[rows]) * weight[rows, None] / len(rows)
            step_soft, step_embed = hidden.T @ error, mix.T @ (error @ soft.T)
            seen_soft += (step_soft**2).sum(axis=0)
            seen_embed[used] += (step_embed**2).mean(axis=1)
            soft -= 0.2 * rate * step_soft / np.sqrt(seen_soft)
            embed[used] = part - rate * step_embed / np.sqrt(seen_embed[used])[:, None]
    return embed @ soft


def text_logits(texts: list[str | None], table: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Average logits of each text's n-grams by class, and the number of n-grams."""
    raw, starts = joined(texts, shape)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for place, bucket in ngrams(raw, shape):
        cuts = np.searchsorted(place, starts)
        count += np.diff(cuts)
        for c in range(table.shape[1]):
            total[:, c] += np.diff(np.concatenate([[0.0], np.cumsum(table[bucket, c], dtype=np.float64)])[cuts])
    return total / np.maximum(count, 1)[:, None], count


def word_scores(texts: list[str | None], scores: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Average score of the n-grams of each word; the words' starts, ends; each text's first word.

    A number scores lowest: it is no word.
    """
    raw, starts = joined(texts, shape)
    solid = raw != BLANK
    first = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    last = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    total, count = np.zeros(len(first)), np.zeros(len(first))
    for place, bucket in ngrams(raw, shape):
        cuts = np.searchsorted(place, first)
        cuts = np.append(cuts, len(place))
        total += np.diff(np.concatenate([[0.0], np.cumsum(scores[bucket], dtype=np.float64)])[cuts])
        count += np.diff(cuts)
    letters = np.concatenate([[0], np.cumsum(raw >= 97)])
    average = np.where(letters[last] > letters[first], total / np.maximum(count, 1), -np.inf)
    return average, first, last, np.searchsorted(first, starts)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias last) of a weighted logistic regression with a small ridge.

    Newton steps on standardised columns, halved until they lower the loss, so that rows
    which a line separates are no trouble.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight = weight / max(weight.mean(), 1e-12)
    w = np.zeros(z.shape[1])

    def loss(w):
        s = z @ w
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + ridge / 2 * (w[:-1] ** 2).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        keep = np.append(np.full(len(w) - 1, ridge), 1e-9)
        slope = z.T @ (weight * (p - y)) + keep * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9:
            break
        w, now = w - size * step, then
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - (slopes * mean).sum())
