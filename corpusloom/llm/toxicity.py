"""Toxicity by a support vector machine over a gapped subsequence string kernel.

Two words are compared by the subsequences of three characters they share, each
occurrence weighing DECAY to the power of the span it covers, at most P + GAPS
characters; the cosine of these weights, raised to POWER, is the kernel of two words,
and the sum over all pairs of distinct words that of two texts. So "id-i-ot", "idxiot"
and "i d i o t" stay near "idiot", and thousands of unrelated words add up to little.
The Nystroem map of a sample of landmark words feeds a linear machine. As the kernel of
a text is a sum over its words, so is its margin: each word has a share of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, hold_cache, materialize, text_batches

#: Chosen by accuracy on labelled texts of sf0.1 that are kept from training.
P, GAPS, DECAY, POWER = 3, 2, 0.7, 8
#: Most landmarks; a small sample has one for six texts.
LANDMARKS = 256
#: Cost of the machine, how much heavier the clean texts weigh than the toxic ones, and the
#: words that virtual examples are made of.
COST, CLEAN, VIRTUAL = 1e7, 4.0, 64
#: The training sample: labelled texts of each class, and the characters of a class after
#: which no further text is added to it. Texts count whole.
SAMPLE, SAMPLE_CHARS = 2000, 16_000_000
#: Characters whose subsequences are counted together: a bound for the memory of a step.
STEP = 20_000
#: Words whose shares a worker keeps (about 120 bytes each); beyond it the cache starts anew.
CACHE = 250_000

_OFFSETS = [(a, b) for b in range(P - 1, P + GAPS) for a in range(1, b)]
_NO_LETTER = re.compile(r"[\W_]+")
#: Single characters in a row, spaces between: a word spelt out.
_SPELT = re.compile(r"(?<!\S)\w(?:[^\S\n]+\w){2,}(?!\S)")


def _counted(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the subsequences of rows of characters padded by 0, one entry
    for each code of a row, ordered by both."""
    n, width = chars.shape
    codes, weights = [], []
    for a, b in _OFFSETS:
        if b < width:
            x = (chars[:, : width - b] << 42) | (chars[:, a : width - b + a] << 21) | chars[:, b:]
            x[chars[:, b:] == 0] = 0
            codes.append(x)
            weights.append(np.full(x.shape, DECAY ** (b + 1)))
    if not codes:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    code, weight = np.concatenate(codes, axis=1), np.concatenate(weights, axis=1)
    order = np.argsort(code, axis=1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    row = np.repeat(np.arange(n), code.shape[1])
    code, weight = code.ravel(), weight.ravel()
    keep = code > 0
    row, code, weight = row[keep], code[keep], weight[keep]
    if not len(code):
        return row, code, weight
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1]))))
    return row[first], code[first], np.add.reduceat(weight, first)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the subsequences of each word between its bounds, weights
    scaled to norm 1. A long word is counted a part at a time."""
    size = np.array([len(w) + 2 for w in words])
    if len(words) == 1 and size[0] > STEP:
        flat = np.frombuffer(f"\x02{words[0]}\x03".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        code, weight = np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, len(flat), STEP):
            # A part's subsequences start in it; what starts in its overlap with the next is taken off.
            for part, sign in ((flat[lo : lo + STEP + P + GAPS - 1], 1.0), (flat[lo + STEP : lo + STEP + P + GAPS - 1], -1.0)):
                _, c, w = _counted(part[None, :])
                code, at = np.unique(np.concatenate([code, c]), return_inverse=True)
                weight = np.bincount(at, np.concatenate([weight, sign * w]), len(code))
        row = np.zeros(len(code), np.int64)
    else:
        chars = np.zeros((len(words), int(size.max(initial=1))), dtype=np.int64)
        flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        chars[np.arange(chars.shape[1])[None, :] < size[:, None]] = flat
        row, code, weight = _counted(chars)
    return row, code, weight / np.sqrt(np.bincount(row, weight**2, len(words)))[row]


class Landmarks:
    """Kernel values of words with a list of landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        row, code, weight = features(landmarks)
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), len(landmarks)), dtype=np.float32)
        self.table[at, row] = weight
        self.gram = (self.table.T.astype(np.float64) @ self.table) ** POWER

    def kernel(self, words: list[str]) -> np.ndarray:
        """(len(words), landmarks)."""
        out = np.zeros((len(words), self.table.shape[1]), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # alike lengths: little padding
        while order:
            n = max(1, min(len(order), STEP // (len(words[order[-1]]) + 2)))
            part, order = order[-n:], order[:-n]
            row, code, weight = features([words[i] for i in part])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            row, at, weight = row[hit], at[hit], weight[hit]
            # The codes of each word side by side, padded by one of weight 0.
            have = np.bincount(row, minlength=n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
            codes_of, weights = np.zeros((n, int(have.max(initial=0))), dtype=np.int64), np.zeros((n, 1, int(have.max(initial=0))), dtype=np.float32)
            codes_of[row, place], weights[row, 0, place] = at, weight
            for lo in range(0, n, 100):
                out[part[lo : lo + 100]] = (weights[lo : lo + 100] @ self.table[codes_of[lo : lo + 100]])[:, 0]
        return out**POWER


def tokens(text: str | None) -> set[str]:
    """The distinct words of a text: letters and digits of its tokens in lower case; single
    characters in a row are one word too."""
    low = (text or "").lower()
    out = {w if w.isalnum() else _NO_LETTER.sub("", w) for w in set(low.split())}
    out.update("".join(m.group().split()) for m in _SPELT.finditer(low))
    out.discard("")
    return out


@dataclass
class Model:
    """A trained scorer. Without training texts of both classes every score is 0."""

    landmarks: list[str]
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._reset()

    def __getstate__(self):
        return self.landmarks, self.weight, self.bias

    def __setstate__(self, state) -> None:
        self.landmarks, self.weight, self.bias = state
        self._reset()

    def _reset(self) -> None:
        self.marks = Landmarks(self.landmarks) if self.landmarks else None
        self.share: dict[str, float] = {}

    def empty_cache(self) -> None:
        self.share.clear()

    def resident(self) -> Model:
        """The worker's own copy of this model, which keeps its words from task to task."""
        same = _resident and _resident[0].landmarks == self.landmarks and np.array_equal(_resident[0].weight, self.weight) and _resident[0].bias == self.bias
        if not same:
            _resident[:] = [self]
        hold_cache(_resident[0])
        return _resident[0]

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the shares of a text's words, and the bias."""
        sets, share = [tokens(t) for t in texts], self.share
        new = [w for w in set().union(*sets) if w not in share]
        if len(share) + len(new) > CACHE:
            share.clear()
            new = list(set().union(*sets))
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            share.update(zip(part, (self.marks.kernel(part) @ self.weight).tolist(), strict=True))
        # An exact sum, so that it doesn't depend on the order of a set.
        return np.array([fsum(map(share.__getitem__, s)) for s in sets]) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-4.0 * np.clip(self.margins(texts), -50, 50)))


_resident: list[Model] = []


def choose_landmarks(toxic: Counter[str], clean: Counter[str], n_toxic: int, n_clean: int, most: int = LANDMARKS) -> list[str]:
    """A weighted sample of all words without repetition, by how far a word's shares of the
    toxic and of the clean texts lie apart."""
    names = sorted(toxic.keys() | clean.keys())
    apart = np.array([abs(toxic[w] / n_toxic - clean[w] / n_clean) for w in names])
    draw = np.random.default_rng(11).random(len(names))
    keys = np.log(draw) / (apart**1.5 + 1e-9)
    return [names[i] for i in np.sort(np.argsort(-keys, kind="stable")[:most])]


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float, ratio: float) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by Newton steps; ratio: how much heavier than
    the toxic examples the clean ones weigh together."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 1.0 / max(1, (y > 0).sum()), ratio / max(1, (y < 0).sum())) * cost
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        gap = 1 - y * (x @ w)
        on = gap > 0
        c = each[on]
        grad = ridge @ w - 2 * x[on].T @ (c * y[on] * gap[on])
        step = np.linalg.solve(ridge + 2 * (x[on] * c[:, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def virtual(toxic: Counter[str], clean: Counter[str], n_toxic: int, n_clean: int) -> list[list[str]]:
    """For each word that marks toxic texts: itself and forms with one or two characters put in."""
    marks = [w for w, n in toxic.items() if n >= 3 and len(w) >= 4 and n / n_toxic > 20 * (clean[w] + 0.5) / n_clean]
    rng, out = np.random.default_rng(5), []
    letters = sorted({c for w in marks for c in w})
    for w in sorted(marks, key=lambda w: (-toxic[w], w))[:VIRTUAL]:
        forms = [w]
        for n in (1, 1, 1, 1, 2, 2):
            s = w
            for _ in range(n):
                at = int(rng.integers(1, len(s)))
                s = s[:at] + letters[int(rng.integers(0, len(letters)))] + s[at:]
            forms.append(s)
        out.append(forms)
    return out


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit landmarks, Nystroem map and machine to labelled texts on the driver.

    Besides the labelled texts, clean ones with a form of a toxic word added count as toxic,
    so that one such word, also with characters put in, is enough."""
    seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        seen[bool(y)].update(tokens(t))
    n = len(labels) - sum(map(bool, labels)), sum(map(bool, labels))
    if not n[0] or not n[1]:
        return Model([], np.zeros(0), -1.0)
    marks = choose_landmarks(seen[1], seen[0], n[1], n[0], min(LANDMARKS, max(16, sum(n) // 6)))
    forms = virtual(seen[1], seen[0], n[1], n[0])
    del seen
    kernels = Landmarks(marks)
    value, vector = np.linalg.eigh(kernels.gram)
    root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T  # the inverse root of the Gram matrix
    x = np.zeros((len(texts), len(marks)))
    for lo in range(0, len(texts), 200):
        sets = [tokens(t) for t in texts[lo : lo + 200]]
        words = list(set().union(*sets))
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            values = kernels.kernel(part)
            name = {w: i for i, w in enumerate(part)}
            for i, s in enumerate(sets):
                mine = [name[w] for w in s & name.keys()]
                x[lo + i] += values[sorted(mine)].sum(axis=0)
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    hosts = np.flatnonzero(y < 0)
    made = [kernels.kernel(f).astype(np.float64) for f in forms]
    made = [k + x[hosts[(7 * i + np.arange(len(k))) % len(hosts)]] for i, k in enumerate(made)]
    weight, bias = fit_machine(np.vstack([x, *made]) @ root, np.concatenate([y, np.ones(sum(map(len, made)))]), COST, CLEAN)
    return Model(marks, root @ weight, bias)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most `sample` labelled texts of each class, none held out: those whose
    ids have the lowest hashes, until they have `chars` characters together; the text that
    reaches that number is the last. Texts of any length count whole. The bound keeps
    training on the driver at any size of the corpus; nothing else of the operator is
    bounded. An id with several texts counts with the smallest, with several labels as
    toxic; null labels and ids take no part, nor do documents without a text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    lengths = base.select("doc_id", F.length("text").alias("size"))  # texts are not shuffled
    sizes = lengths.join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size"))
    picked = None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    for y in (0, 1):
        part = sizes.where(F.col("toxic") == y).orderBy(*order).limit(sample)
        before = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # of `sample` rows
        part = part.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars).select("doc_id", "toxic")
        picked = part if picked is None else picked.union(part)
    # At most 2 * sample rows of two numbers.
    rows = base.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def _score(model: Model):
    def run(batches):
        own = model.resident()
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part = batch.slice(lo, 100)
                s = own.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
            part = batch = None  # not held while the next one is read
        hold_cache(None)

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text, a row for each row of `docs`.

    A null or empty text has no words and gets the score of a text unlike all landmarks;
    words of any length are compared whole. Repeated ids are scored each by its own text; a
    null id is not held out. Equal texts get equal scores, 0.5 itself is toxic. Further
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(_score(model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose id no text scores 0.5 or more under.

    Only ids come back from the scoring, in a table of their own, so texts pass to Python
    but not back. A row without an id goes if its own text is rejected."""
    with text_batches(docs.sparkSession):
        flagged = materialize(score_toxicity(docs, model).where("predicted = 1").select("doc_id").distinct(), "toxic")
    n = flagged.count()
    named = docs.join(broadcast_if_small(flagged.where("doc_id is not null"), n), "doc_id", "left_anti").select(*docs.columns)
    if not flagged.where("doc_id is null").limit(1).count():
        return named
    text = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text).to_pylist()) < 0.5))

    return named.where("doc_id is not null").union(docs.where("doc_id is null").mapInArrow(keep, docs.schema))
