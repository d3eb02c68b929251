"""Toxicity by a chain of linear classifiers.

Categories are predicted in order.  Each has a logistic regression over the
presence of words, hashed into a fixed space; from the second on it also sees the
probabilities of the categories before it.  In training those are out-of-fold
predictions, so a later model learns from probabilities as uncertain as the ones
it will be given.  A model sees the words whose share in its category differs from
chance among its own training rows, so a fold's labels tell nothing about it.

The models are fitted on the driver from a bounded sample of labelled documents
(``max_rows``, by a hash of the id); every document is then judged whole, and
nothing is shuffled for it.

Defined results: a null text has no words; a label row with a null is not used,
of several for one document the highest counts; without a usable label of both
values a category's probability is the share of its positives (about 0 without any);
equal texts get equal probabilities; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

MAX_ROWS, FOLDS, PENALTY = 8000, 5, 0.3
#: Bits of the space that words are hashed into.
SPACE = 18
#: Standard deviations by which a word's share in a category must differ; thousands of words stay below by chance.
LEAST_Z = 3.4

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Chain:
    """Categories in order, the words' places in the space (sorted), and for each category weights (words, earlier probabilities, constant)."""

    categories: list[str]
    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    limit: float = 0.5

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        row, place = presence(texts)
        k = np.minimum(np.searchsorted(self.words, place), max(0, len(self.words) - 1))
        hit = self.words[k] == place if len(self.words) else np.zeros(len(k), bool)
        row, k, out = row[hit], k[hit], np.zeros((len(texts), 0))
        for w in self.weights:
            z = np.bincount(row, w[k], minlength=len(texts)) + np.column_stack([out, np.ones(len(texts))]) @ w[len(self.words) :]
            out = np.column_stack([out, _sigmoid(z)])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased tokens and their rows."""
    data, offs = A.text_bytes(texts)
    low = _LOWER[data]
    start, end, first = A.spans(low, offs, _TOKEN)
    return A.span_hashes(low, start, end), A.rows_of(first)


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, once each, as (row, place in the space), sorted."""
    h, row = token_hashes(texts)
    both = np.unique(row.astype(np.int64) << SPACE | (h >> A.U(64 - SPACE)).astype(np.int64))
    return both >> SPACE, both & ((1 << SPACE) - 1)


def telling(row: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places whose share in y = 1 is further from chance than ``LEAST_Z`` allows."""
    n, share = max(1, len(y)), y.mean() if len(y) else 0.0
    df = np.bincount(place, minlength=1 << SPACE).astype(float)
    spread = df * share * (1 - share) * (1 - df / (n + 1)) + 1
    return np.flatnonzero(np.abs(np.bincount(place, y[row], minlength=1 << SPACE) - df * share) >= LEAST_Z * np.sqrt(spread))


def fit_logistic(row: np.ndarray, col: np.ndarray, words: int, dense: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression over sparse 0/1 columns and a few dense ones, the last of which is the constant and free.

    Newton steps, each solved by conjugate gradients.
    """
    n, k = len(y), words + dense.shape[1]
    ridge = np.full(k, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(k)
    rate = np.clip(y.mean() if n else 0.0, 1e-9, 1 - 1e-9)
    w[-1] = np.log(rate / (1 - rate))
    if len(np.unique(y)) < 2:
        return w
    times = lambda v: np.bincount(row, v[col], minlength=n) + dense @ v[words:]
    back = lambda v: np.r_[np.bincount(col, v[row], minlength=words), dense.T @ v]
    for _ in range(rounds):
        p = _sigmoid(times(w))
        v = np.maximum(p * (1 - p), 1e-9)
        rest = back(y - p) - ridge * w
        scale = np.r_[np.bincount(col, v[row], minlength=words), (dense**2).T @ v] + ridge
        step, to = np.zeros(k), rest / scale
        size = first = rest @ to
        for _ in range(100):
            if size <= 1e-6 * max(first, 1e-300):
                break
            along = back(v * times(to)) + ridge * to
            far = size / (to @ along)
            step += far * to
            rest = rest - far * along
            last, size = size, rest @ (rest / scale)
            to = rest / scale + size / last * to
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(row: np.ndarray, place: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities of the training rows, whose words are (row, place)."""
    n, held, models = len(y), np.zeros((len(y), 0)), []

    def fitted(train: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and weights of category j, from some of the rows alone."""
        new, inside = np.cumsum(train) - 1, train[row]
        r, c = new[row[inside]], place[inside]
        words = telling(r, c, y[train, j])
        at = np.full(1 << SPACE, -1)
        at[words] = np.arange(len(words))
        seen = at[c] >= 0
        return words, fit_logistic(r[seen], at[c[seen]], len(words), np.column_stack([held, np.ones(n)])[train], y[train, j])

    for j in range(len(categories)):
        p = np.full(n, y[:, j].mean() if n else 0.0)
        for f in np.unique(fold):
            out = fold == f
            if (~out).any():
                words, w = fitted(~out, j)
                of = np.zeros(1 << SPACE)
                of[words] = w[: len(words)]
                p[out] = _sigmoid(np.bincount(row, of[place], minlength=n) + np.column_stack([held, np.ones(n)]) @ w[len(words) :])[out]
        models.append(fitted(np.ones(n, bool), j))
        held = np.column_stack([held, p])
    words = np.unique(np.concatenate([m[0] for m in models])) if models else np.zeros(0, np.int64)
    chain = Chain(categories, words)
    for own, w in models:
        chain.weights.append(np.r_[np.zeros(len(words)), w[len(own) :]])
        chain.weights[-1][np.searchsorted(words, own)] = w[: len(own)]
    if n and categories:
        p, t = held[:, -1], y[:, -1] > 0.5
        score = lambda c: 2 * ((p >= c) & t).sum() / max(1, (p >= c).sum() + t.sum())
        # most of what is rejected must be rejected rightly
        fit = [c for c in (round(v, 2) for v in np.arange(0.1, 0.95, 0.05)) if 2 * ((p >= c) & t).sum() > (p >= c).sum()]
        chain.limit = max(fit, key=lambda c: (score(c), -abs(c - 0.5)), default=0.5)
    return chain, held


def train(docs: DataFrame, labels: DataFrame, categories: list[str], *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """``labels`` has the id and a 0/1 column for each category."""
    y = [F.col(c).cast("int").alias(f"y{j}") for j, c in enumerate(categories)]
    given = labels.select(F.col(id_col).cast("long").alias("_id"), *y).dropna()
    given = given.groupBy("_id").agg(*[F.max(f"y{j}").alias(f"y{j}") for j in range(len(y))])
    n = given.count()
    # about max_rows rows, whatever the number of labels
    sample = given if n <= max_rows else given.where(F.pmod(F.xxhash64(F.lit(3), F.col("_id")), F.lit(n)) < max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "inner").drop("_id")
    names = ["doc_id", *[f"y{j}" for j in range(len(y))]]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, "text"):
                row, place = presence(b.column(1))
                offs = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], lists], [*names, "places"])

    # at most about max_rows rows, each with its different words
    marked = texts.mapInArrow(words, ", ".join(["doc_id long", *[f"y{j} int" for j in range(len(y))], "places array<int>"])).toArrow().combine_chunks()
    doc = A.ids(marked["doc_id"].combine_chunks())
    lists = marked["places"].combine_chunks()
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    row, place = np.repeat(np.arange(len(doc)), size), np.asarray(lists.flatten()).astype(np.int64)
    labelled = np.array([np.asarray(marked[c]) for c in names[1:]], float).T.reshape(len(doc), len(y))
    # the order of rows, and so of sums, is the same in each run
    turn = np.lexsort((np.bincount(row, A.mix(place.astype(A.U)) >> A.U(20), minlength=len(doc)), *labelled.T, doc))
    rank = np.argsort(turn)
    order = np.lexsort((place, rank[row]))
    fold = (A.mix(doc.view(A.U)) % A.U(FOLDS)).astype(int)
    return fit_chain(rank[row][order], place[order], labelled[turn], fold[turn], categories)[0]


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` (of any names but p_* and rejected), p_<category> for each, and rejected."""
    want = docs.select(*keep, F.col(text_col).alias("_text_"))
    names = [*keep, *[f"p_{c}" for c in chain.categories], "rejected"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, "_text_"):
                p = chain.probabilities(b.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(np.ascontiguousarray(p[:, j])) for j in range(p.shape[1])], pa.array(p[:, -1] >= chain.limit)], names)

    kinds = dict(want.dtypes)
    return want.mapInArrow(fn, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`p_{c}` double" for c in chain.categories], "rejected boolean"]))


def reject(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain's last category does not reject, unchanged."""
    at = docs.columns.index(text_col)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, text_col):
                p = chain.probabilities(b.column(at))
                yield b.filter(pa.array(p[:, -1] < chain.limit))

    return docs.mapInArrow(fn, docs.schema)
