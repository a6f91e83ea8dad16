"""Language by a string kernel: two texts are alike by the byte n-grams (1 to 4) that both have.

The blended-spectrum presence kernel, normalised, is approximated from Nystrom landmarks; one-versus-rest kernel ridge
regression on that map gives a weight for each landmark and language. A batch of texts is scored by two matrix products:
presence x landmarks, then kernel x weights. A text of more than PART bytes is the mean of its even parts, all of which count, in
training as in scoring: however long it is, it doesn't fill the space, and its score doesn't depend on its length.

Edge cases: `und`, score 0, for a null text or one without letters (Unicode category L), or when nothing could be learned; null
ids are scored and never held out; null langs aren't learned; repeated rows are scored alike; of languages with equal scores the
first in order wins; an empty table gives an empty result; other columns are read only where carried, under names of their own, so
none can clash. Very long texts: ROWS parts are held at a time, and a few copies of the text's bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.llm.text import Powers, Texts, U, mix, scan
from voxelgraph.llm.training import fold, sample_ids, sample_texts

SPACE, LANDMARKS, PER_CLASS, GRAMS, ROWS = 1 << 13, 96, 500, (1, 2, 3, 4), 256

#: Bytes of the longest part.
PART = 1 << 13


def parts_of(t: Texts, most: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Where the even parts of each text begin, and the end of the last; the text of each part."""
    size = np.diff(t.off)
    n = np.maximum(1, -(-size // most))
    own = np.repeat(np.arange(t.n), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return np.append(t.off[own] + k * size[own] // n[own], t.off[-1]), own


def presence(t: Texts, space: int = SPACE, at: np.ndarray | None = None, rows: tuple[int, int] | None = None) -> np.ndarray:
    """(parts, space) float32: 1 where a part has an n-gram hashed there. t: lower-cased. at: as from parts_of(); each text is one part
    without. rows: only these parts. An n-gram is of the part that it begins in."""
    at = t.off if at is None else at
    a, b = rows or (0, len(at) - 1)
    out = np.zeros((b - a, space), np.float32)
    flat, low, high = out.reshape(-1), int(at[a]), int(at[b])
    some = Texts(pa.array([], pa.large_string()), t.powers)
    some.data = t.data[low : min(high + max(GRAMS) - 1, len(t.data))]
    size, prefix = len(some.data), some.prefix()
    _, down = t.powers.upto(size + 1)
    own = np.repeat(np.arange(b - a) * space, np.diff(at[a : b + 1]))
    cut = np.zeros(size + 1, np.int32)
    inner = t.off[(t.off > low) & (t.off <= low + size)] - low
    np.add.at(cut, inner, 1)
    text = np.cumsum(cut)[:size]
    for n in GRAMS:
        m = min(size - n + 1, high - low)
        if m <= 0:
            break
        h = mix((prefix[n : n + m] - prefix[:m]) * down[:m] + U(n))
        same = text[:m] == text[n - 1 : n - 1 + m]
        flat[(own[:m] + (h & U(space - 1)).astype(np.int64))[same]] = 1
    return out


def blocks(at: np.ndarray, most: int = ROWS) -> list[tuple[int, int]]:
    """Runs of parts that are held at a time."""
    return [(a, min(a + most, len(at) - 1)) for a in range(0, len(at) - 1, most)]


def mean_of(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The mean row of each text."""
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    return np.add.reduceat(rows, begin, axis=0) / np.diff(np.append(begin, len(own)))[:, None]


@dataclass
class StringKernel:
    classes: list
    landmarks: np.ndarray  # (landmarks, space), each the mean of parts divided by their lengths
    weights: np.ndarray  # (landmarks, classes)

    def score(self, x: np.ndarray) -> np.ndarray:
        length = np.sqrt(x.sum(1, keepdims=True))
        return (x @ self.landmarks.T / np.maximum(1, length)) @ self.weights


def train(texts: list[str], labels: list, space: int = SPACE, landmarks: int = LANDMARKS, ridge: float = 1e-2, seed: int = 1) -> StringKernel | None:
    if not texts:
        return None
    classes, powers, x = sorted(set(labels)), Powers(), []
    for n in range(0, len(texts), 64):
        t = Texts(pa.array(texts[n : n + 64], pa.large_string()), powers).lower()
        at, own = parts_of(t)
        total = np.zeros((t.n, space), np.float32)
        for a, b in blocks(at):
            part = presence(t, space, at, (a, b))
            np.add.at(total, own[a:b], part / np.maximum(1, np.sqrt(part.sum(1, keepdims=True))))
        x.append(total / np.bincount(own, minlength=t.n)[:, None].astype(np.float32))
    x = np.concatenate(x)
    y = np.array([classes.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    per = -(-landmarks // len(classes))
    pick = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:per] for c in range(len(classes))])
    mark = x[pick]
    k_nm, k_mm = (x @ mark.T).astype(float), (mark @ mark.T).astype(float)
    value, vector = np.linalg.eigh(k_mm)
    ok = value > 1e-6 * value.max() if value.max() > 0 else np.zeros(len(value), bool)
    root = vector[:, ok] / np.sqrt(value[ok])  # k_mm to the power -1/2, on its range
    z = k_nm @ root
    share = np.bincount(y, minlength=len(classes)) / len(y)
    rows = (1 / (len(classes) * share))[y]  # each language counts alike
    target = 2.0 * (y[:, None] == np.arange(len(classes))) - 1
    w = np.linalg.solve((z * rows[:, None]).T @ z + ridge * len(y) * np.eye(z.shape[1]) / 10, (z * rows[:, None]).T @ target)
    return StringKernel(classes, mark.astype(np.float32), (root @ w).astype(np.float32))


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int = 4, held: int = 2, per_class: int = PER_CLASS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns in carry (under _0, _1, ...) for every row of docs. labelled: doc_id, text, lang; folds other than `held` are learned."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    known = labelled.where(fold("doc_id", parts) != held).select("doc_id", F.col("lang").alias("label"))
    got = sample_texts(labelled, sample_ids(known, per_class))
    model = docs.sparkSession.sparkContext.broadcast(train(got["text"].tolist(), got["label"].tolist()))

    def make():
        import regex

        kernel, letter = model.value, regex.compile(r"\p{L}")

        def work(part, t):
            score = np.zeros(t.n)
            spell = [bool(letter.search(s or "")) for s in part.column("text").to_pylist()]
            if kernel is None:
                return part.column("doc_id"), ["und"] * t.n, score
            t.lower()
            at, own = parts_of(t)
            f = mean_of(np.concatenate([kernel.score(presence(t, at=at, rows=r)) for r in blocks(at)]), own) if t.n else np.zeros((0, len(kernel.classes)))
            best = f.argmax(1) if t.n else np.zeros(0, int)
            score[:] = np.clip((1 + f[np.arange(len(f)), best]) / 2, 0, 1)
            pred = [str(kernel.classes[b]) for b in best]
            return part.column("doc_id"), [p if ok else "und" for p, ok in zip(pred, spell)], np.where(spell, score, 0.0)

        return work

    more = tuple(f"_{i}" for i in range(len(carry)))
    out = scan(rows, make, "doc_id long, lang_pred string, score double", carry=more)
    return out.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", *more)
