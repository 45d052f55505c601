"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares tokens by their common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the power
of the characters that it skips, up to ``SPAN`` characters long; so gaps and inserted characters weaken a match and do
not end it. Token ends count as a character. Values are divided by both norms. A small set of landmark tokens gives
each token its Nystroem features, and a linear machine with squared hinge loss is trained on these. As the kernel is a
product of subsequence weights, the trained machine folds into one weight for each subsequence, so scoring a token costs
the same for any number of landmarks.

Training: a bounded sample of the labelled sentences' documents (``MOST_DOCS``, the smallest hashes of their ids) gives
for each token, and each beginning of tokens, the documents of either label that hold it. Those that toxic documents
hold more than chance allows make the examples of insults, the others those of clean tokens. A document's score is a logistic function
of the values of its three worst tokens, set on the same sample. Spelled-out
insults ("i d i o t") are read as one more token. Tokens longer than ``WINDOW`` are read in overlapping windows.

Null and empty texts have the score of no evidence. Without labels of both kinds, or any telling token, every score is 0. Labels, language,
source and id are never inputs of a score. Repeated rows are scored each; rows of ``labels`` that disagree,
and equal texts with unlike labels, count as toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.llm.common import Scratch, lots

MOST_DOCS = 12_000  #: labelled documents that training reads at most
MOST_TOKENS = 12_000  #: distinct tokens that training reads at most
LANDMARKS = 384
ORDER, SPAN, DECAY = 3, 5, 0.7
WINDOW, STRIDE = 24, 12
EXPLAINED = 0.5  #: what an explanation leaves of a document's weight
BEGINNING = 8  #: longest beginning of tokens that training counts
CACHE = 100_000  #: tokens, or counts of keys, that a task holds at most
LOT = 64  #: texts that are scored at a time
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]  #: places of the second and third character after the first
_WEIGHT = np.array([DECAY ** (k - 2) for _, k in _GAPS])
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){3,}[^\W\d_](?!\w)")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def _code(c: str) -> int:
    """Six bits for a character: ASCII letters and digits apart, all others shared out."""
    n = ord(c)
    return n - 96 if 97 <= n <= 122 else 27 + n - 48 if 48 <= n <= 57 else 38 + n % 25


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = v = _code(c)
        return v


_codes = _Codes()


def subsequences(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token number, subsequence number, weight) of each distinct subsequence of each token."""
    size = np.array([len(t) + 2 for t in tokens])
    pad = SPAN - 1
    start = np.concatenate([[0], np.cumsum(size + pad)])
    codes = np.full(start[-1] + pad, -1, np.int64)
    owner = np.full(start[-1] + pad, -1, np.int64)
    flat = np.fromiter((_codes[c] for t in tokens for c in t), np.int64, int(size.sum()) - 2 * len(tokens))
    inside = np.repeat(start[:-1] + 1, size - 2) + np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size - 2)])[:-1], size - 2)
    codes[inside] = flat
    codes[start[:-1]] = codes[start[:-1] + size - 1] = 37  # the ends
    at = np.repeat(start[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
    owner[at] = np.repeat(np.arange(len(tokens)), size)
    keys, weights = [], []
    for (j, k), w in zip(_GAPS, _WEIGHT, strict=True):
        a, b, c = codes[at], codes[at + j], codes[at + k]
        ok = (b >= 0) & (c >= 0) & (owner[at + k] == owner[at])
        keys.append(owner[at][ok] << 18 | a[ok] << 12 | b[ok] << 6 | c[ok])
        weights.append(np.full(ok.sum(), w))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    weights = np.add.reduceat(weights, first) if len(keys) else weights
    keys = keys[first]
    return keys >> 18, keys & 0x3FFFF, weights


def _unit(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, each token's weights divided by their norm."""
    of, sub, w = subsequences(tokens)
    norm = np.sqrt(np.bincount(of, w * w, len(tokens)))
    return of, sub, w / norm[of]


def windows(token: str) -> list[str]:
    return [token] if len(token) <= WINDOW else [token[i : i + WINDOW] for i in range(0, len(token) - STRIDE, STRIDE)]


def tokens_of(text: str | None) -> set[str]:
    """Distinct lower-case tokens of a text, bare of marks at their ends; spelled-out words are one more token."""
    if not text:
        return set()
    text = text.lower()
    raw = set(text.split())
    for m in _SPELLED.finditer(text):
        raw.add("".join(c for c in m.group() if c.isalpha()))
    return raw


def bare(token: str) -> str:
    return _TRIM.sub("", token)


def keys_of(text: str | None) -> set[str]:
    """The tokens of a text, in windows, and their beginnings, marked by a star."""
    found = {w for t in {bare(t) for t in tokens_of(text)} if len(t) >= 2 for w in windows(t)}
    return found | {w[:n] + "*" for w in found for n in range(3, min(len(w), BEGINNING + 1))}


@dataclass
class Model:
    """The folded machine: a weight for each subsequence, a bias, and a logistic scale over a document's greatest values."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray | None = None  #: weights of the ``TOP`` greatest values, and a bias

    def values(self, tokens: list[str]) -> np.ndarray:
        """The machine's value of each token; the greatest of its windows for long ones."""
        parts = [windows(t) for t in tokens]
        flat = [w for p in parts for w in p]
        if not flat:
            return np.zeros(0)
        of, sub, w = _unit(flat)
        v = np.bincount(of, w * self.weights[sub], len(flat)) + self.bias
        return np.maximum.reduceat(v, np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))

    def scores(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.scale[:-1] + self.scale[-1], -30, 30)))


TOP = 3  #: greatest token values of a document that its score is made of
NOTHING = -2.0  #: where a text has fewer tokens


class Scorer:
    """The greatest values over each text's distinct tokens; tokens met before are looked up."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def top(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; some texts at a time, so that few tokens are held besides the known ones."""
        return np.concatenate([self._top(texts[i : i + LOT]) for i in range(0, len(texts), LOT)]) if texts else np.zeros((0, TOP))

    def _top(self, texts: list[str | None]) -> np.ndarray:
        known, all_tokens = self.known, [tokens_of(t) for t in texts]
        new = list(set().union(*all_tokens).difference(known)) if all_tokens else []
        for i in range(0, len(new), 4000):
            some = new[i : i + 4000]
            short = [bare(t) for t in some]
            full = [t for t in short if len(t) >= 2]
            values = dict(zip(full, self.model.values(full), strict=True))
            known.update((t, values.get(s, NOTHING)) for t, s in zip(some, short, strict=True))
        fill = [NOTHING] * TOP
        out = np.array([(nlargest(TOP, map(known.__getitem__, ts)) + fill)[:TOP] for ts in all_tokens]).reshape(-1, TOP)
        if len(known) > CACHE:
            known.clear()
        return out


def train_machine(features: np.ndarray, positive: np.ndarray, negative: np.ndarray, cost: float = 4.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by Newton steps; each row is an example of both labels, with these weights."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3

    def loss(w):
        f = x @ w
        return 0.5 * w @ ridge @ w + cost * (positive * np.maximum(0, 1 - f) ** 2 + negative * np.maximum(0, 1 + f) ** 2).sum()

    for _ in range(rounds):
        f = x @ w
        on = np.where(f < 1, positive, 0) + np.where(f > -1, negative, 0)
        slope = np.where(f < 1, -positive * (1 - f), 0) + np.where(f > -1, negative * (1 + f), 0)
        step = np.linalg.solve(ridge + 2 * cost * (x * on[:, None]).T @ x, ridge @ w + 2 * cost * x.T @ slope)
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def gains(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier the labels of the documents that hold a key are at their own rate than at the general one."""
    base = n_toxic / (n_toxic + n_clean)
    taken = np.isinf(clean)
    clean = np.where(taken, 0, clean)
    rate = np.clip(toxic / np.maximum(toxic + clean, 1e-9), 1e-9, 1 - 1e-9)
    gain = toxic * np.log(rate / base) + clean * np.log((1 - rate) / (1 - base))
    return np.where((rate >= max(0.5, base)) & ~taken, gain, 0.0)


def telling(keys: list[str], holders: list[np.ndarray], clean: np.ndarray, n_toxic: int, n_clean: int, n_keys: int) -> set[str]:
    """The keys that explain the toxic documents, greedily by gain; a document counts ``EXPLAINED`` times as much for each key that explains it.

    So what merely stands beside insults, as in copies of one document, hardly explains anything. Of equal gains the longest key
    counts. It ends where chance would give such a gain to any of ``n_keys`` keys. ``holders`` has each key's toxic documents.
    """
    weight, found = np.ones(max((int(h.max()) for h in holders if len(h)), default=0) + 1), set()
    left = np.array([len(h) for h in holders], float)
    size = np.array([len(k) for k in keys])
    while len(found) < len(keys):
        gain = gains(left, clean, n_toxic, n_clean)
        best = int(np.lexsort((size, np.round(gain, 6)))[-1])
        if gain[best] <= np.log(max(n_keys, 2)):
            break
        found.add(keys[best])
        clean = clean.copy()
        clean[best] = np.inf  # it is taken
        weight[holders[best]] *= EXPLAINED
        left = np.array([weight[h].sum() for h in holders])
    return found


def fit_tokens(tokens: list[str], toxic: np.ndarray, clean: np.ndarray, insult: np.ndarray) -> Model:
    """The folded machine of tokens with the numbers of toxic and of clean documents that hold them, and which are insults."""
    rate = np.where(insult, toxic + clean, -clean)
    # landmarks: half from the insults that most documents hold, half from the commonest of the others
    order = np.argsort(-rate, kind="stable")
    half = min(LANDMARKS // 2, int(insult.sum()))
    marks = list(order[:half])
    marks += [i for i in np.argsort(-(toxic + clean), kind="stable") if i not in set(marks)][: LANDMARKS - half]
    of, sub, w = _unit(tokens)
    # only subsequences of landmarks matter: a column for each of these, and one for all others
    mine = np.concatenate([np.arange(*np.searchsorted(of, [m, m + 1])) for m in marks])
    place = np.zeros(len(tokens), np.int64)
    place[marks] = np.arange(len(marks))
    columns = np.unique(sub[mine])
    column = np.full(1 << 18, len(columns), np.int32)
    column[columns] = np.arange(len(columns))
    dense = np.zeros((len(marks), len(columns) + 1), np.float32)
    dense[place[of[mine]], column[sub[mine]]] = w[mine]
    kernel = np.zeros((len(tokens), len(marks)))
    for i in range(0, len(tokens), 256):
        a, b = np.searchsorted(of, [i, min(i + 256, len(tokens))])
        part = dense[:, column[sub[a:b]]] * w[a:b].astype(np.float32)
        at = np.flatnonzero(np.r_[True, of[a + 1 : b] != of[a : b - 1]])
        kernel[of[a:b][at]] = np.add.reduceat(part, at, axis=1).T
    among = kernel[marks]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    # an insult's clean documents count against it, so that its value tells how sure a sign it is
    scale = 4000 / max(1e-9, toxic[insult].sum())
    usual = np.where(insult, 0, np.sqrt(clean + 1))
    w_, bias = train_machine(features, np.where(insult, toxic, 0) * scale, np.where(insult, clean, 0) * scale + usual * 4000 / max(1e-9, usual.sum()))
    share = root @ w_
    return Model(np.bincount(sub[mine], w[mine] * share[place[of[mine]]], 1 << 18), bias)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learnable: Column | None = None) -> Model | None:
    """Train on labelled documents; ``learnable`` is a condition on the ids of ``labels`` that may be read. None without both labels."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.where(learnable) if learnable is not None else marked
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(MOST_DOCS)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # MOST_DOCS rows at most
    sample = scratch.table(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id")), "sample")
    n_toxic, n_clean = (x or 0 for x in sample.agg(F.sum((F.col("toxic") > 0).cast("int")), F.sum((F.col("toxic") <= 0).cast("int"))).first())
    if not n_toxic or not n_clean:
        return None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}

        def told():
            for toxic, own in counts.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([toxic] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], names=["token", "toxic", "n"])
                    own.clear()

        for batch in lots(batches, LOT):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(keys_of(text))
            if sum(map(len, counts.values())) > CACHE:
                yield from told()
        yield from told()

    spread_ = sample.select("text", "toxic").mapInArrow(spread, "token string, toxic int, n long")
    counts = scratch.table(spread_.groupBy("token").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")), "counts")
    # what tells most of either label, and some of all; ties by the token itself
    tells, whole = F.col("t") * (n_clean / n_toxic) - F.col("c"), ~F.col("token").endswith("*")
    parts = counts.where(~whole).orderBy(F.desc(tells), "token"), counts.where(whole).orderBy(F.desc(tells), "token"), counts.where(whole).orderBy(F.asc(tells), "token"), counts.where(whole).orderBy(F.xxhash64("token"))
    rows = sorted({tuple(r) for part in parts for r in part.limit(MOST_TOKENS // 4).collect()})
    names, t, c = [r[0] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    total = counts.count()
    wanted = {n: k for k, n in enumerate(n for n, g in zip(names, gains(t, c, n_toxic, n_clean), strict=True) if g > np.log(max(total, 2)))}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, LOT):
            rows = [[wanted[k] for k in keys_of(x) & wanted.keys()] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["keys"])

    rows = [r[0] for r in sample.where("toxic > 0").select("text").mapInArrow(held, "keys array<int>").collect()]
    of = [[] for _ in wanted]
    for d, own in enumerate(rows):
        for k in own:
            of[k].append(d)
    clean_of = dict(zip(names, c, strict=True))
    found = telling(list(wanted), [np.array(x, np.int64) for x in of], np.array([clean_of[n] for n in wanted]), n_toxic, n_clean, total)
    full = np.array([not n.endswith("*") for n in names])
    insult = np.array([n in found or any(f"{n[:k]}*" in found for k in range(3, min(len(n), BEGINNING + 1))) for n in names])[full]
    if not insult.any():
        return None
    model = fit_tokens([n for n, x in zip(names, full, strict=True) if x], t[full], c[full], insult)
    got = top_values(sample.select("id", "text", "toxic"), docs.sparkSession.sparkContext.broadcast(model)).select("toxic", "top").collect()
    model.scale = logistic(np.array([r.top for r in got]), np.array([r.toxic > 0 for r in got], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights and bias of a logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def top_values(rows: DataFrame, shared) -> DataFrame:
    """``rows`` (with a column text) with ``top`` in the place of the text."""
    kept = [c for c in rows.columns if c != "text"]
    at = [rows.columns.index(c) for c in kept]
    text = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in lots(batches):
            top = scorer.top(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(list(top), pa.list_(pa.float64()))], names=[*kept, "top"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("top", ArrayType(DoubleType())))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, score, predicted (1 if the score is 0.5 or more)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in lots(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(scorer.top(batch.column(1).to_pylist())))], names=["id", "score"])

    out = rows.mapInArrow(run, rows.select("id").schema.add("score", "double"))
    return out.select(F.col("id").alias(id_col), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more. All columns stay; null ids are no matter."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in lots(batches):
            keep = pa.array(shared.value.scores(scorer.top(batch.column(1).to_pylist())) < 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
