"""Toxicity by a subsequence string-kernel machine with Nystrom landmarks (operator 2).

The kernel compares two strings by their common subsequences of three letters, gaps allowed: a subsequence over span s
weighs ``decay ** (s - 3)``, up to a span of ``SPAN``.  Insults with inserted or missing characters thus stay near the
insults that were learned.  Strings are the letters of a token, of runs of single letters ("i d i o t"), and of windows
over very long tokens; every window of the whole text is scored.

Learning: labels are on texts, so the labelled sentences' windows are weighed by how far they keep to toxic texts
(likelihood ratio); those past ``WITNESS`` are the positive examples, windows of clean texts the negative ones.  A
squared-hinge support vector machine is trained in the space that the landmarks span.  As the kernel's features can be
listed, the machine folds into one weight per letter triple, so a window costs one table lookup per triple and the
score is that of the kernel machine itself.  Clean windows that a first machine scores highest join the examples of the
second.  A logistic curve on a text's two largest windows and the sum of its insulting ones gives the score; it is
fitted on the same learning texts.

Fitting reads at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled texts, picked by the hash of their id, and at most
``MAX_WINDOWS`` windows of each kind, all of which are candidates for landmarks; scoring covers every text.

Defined results: null and empty texts get the score of a text without windows; texts of any length are scored whole;
repeated rows score alike; with no labelled text of both kinds all scores are 0; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written

SYMBOLS, SPAN, DECAY = 41, 6, 0.6
WINDOW = 24
MAX_TOXIC, MAX_CLEAN, MAX_WINDOWS, LANDMARKS = 4000, 12_000, 4000, 256
WITNESS, PURITY = 14.0, 0.9
CACHE_TOKENS = 1_000_000
NOTHING = -2.0
#: Windows past this margin count as insulting outright.
SURE = 0.8
APART = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){2,}(?=\s|$)")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def windows_of(token: str) -> list[str]:
    """A token's letters, in overlapping windows where it is long."""
    letters = NOT_LETTERS.sub("", token)
    if len(letters) <= WINDOW:
        return [letters] if len(letters) > 1 else []
    return [letters[i : i + WINDOW] for i in range(0, len(letters) - WINDOW // 2, WINDOW // 2)]


def tokens_of(text: str | None) -> list[str]:
    """White-space tokens in lower case, and the letters of spaced-out words joined."""
    if not text:
        return []
    low = text.lower()
    return low.split() + ["".join(m.group(0).split()) for m in APART.finditer(low)]


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbol numbers between start and end marks."""
    points = np.array([list(map(ord, w)) for w in words])
    plain = (points >= 97) & (points <= 122)
    return np.pad(np.where(plain, points - 96, 27 + points % 12), ((0, 0), (1, 1)), constant_values=((0, 0), (39, 40)))


def triples(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences (rows, number) and their weights (number)."""
    found, weights = [], []
    for span in range(3, min(SPAN, c.shape[1]) + 1):
        for middle in range(1, span - 1):
            end = c.shape[1] - span + 1
            found.append((c[:, :end] * SYMBOLS + c[:, middle : middle + end]) * SYMBOLS + c[:, span - 1 : span - 1 + end])
            weights.append(np.full(end, DECAY ** (span - 3), np.float32))
    return np.concatenate(found, 1), np.concatenate(weights)


def norms(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each word's kernel with itself; a repeated subsequence's weights add up first."""
    order = np.argsort(found, axis=1)
    f, w = np.take_along_axis(found, order, 1), weights[order]
    new = np.ones(f.shape, bool)
    new[:, 1:] = f[:, 1:] != f[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    rows = np.repeat(np.arange(len(f)), new.sum(1))
    return np.sqrt(np.bincount(rows, weights=sums**2, minlength=len(f)))


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, subsequences, weights and norms of the words of each length, in blocks."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for at in groups.values():
        for lo in range(0, len(at), 2000):
            part = at[lo : lo + 2000]
            found, weights = triples(codes([words[i] for i in part]))
            yield part, found, weights, norms(found, weights)


def kernel_features(words: list[str]) -> np.ndarray:
    """Normalised subsequence features, dense: for landmarks only."""
    out = np.zeros((len(words), SYMBOLS**3), np.float32)
    for at, found, weights, norm in by_length(words):
        for row, f, n in zip(at, found, norm, strict=True):
            np.add.at(out[row], f, weights / n)
    return out


def against(words: list[str], table_: np.ndarray) -> np.ndarray:
    """Inner products of the words' normalised features with the columns of ``table_`` (triples, columns)."""
    out = np.zeros((len(words), table_.shape[1]), np.float32)
    for at, found, weights, norm in by_length(words):
        for lo in range(0, len(at), 64):
            out[at[lo : lo + 64]] = np.einsum("bfk,f->bk", table_[found[lo : lo + 64]], weights) / norm[lo : lo + 64, None]
    return out


def window_scores(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for at, found, weights, norm in by_length(words):
        out[at] = weight[found] @ weights / norm + bias
    return out


class TokenScores(dict):
    """Scores of tokens, kept by a worker across tasks; in bounds."""

    def __init__(self, weight: np.ndarray, bias: float):
        super().__init__()
        self.weight, self.bias = weight, bias

    def learn(self, texts: list[list[str]]) -> None:
        tokens = {t for text in texts for t in text if t not in self}
        if len(self) + len(tokens) > CACHE_TOKENS and len(self):
            self.clear()
            tokens = {t for text in texts for t in text}
        words, owners = [], []
        for t in tokens:
            self[t] = NOTHING
            for w in windows_of(t):
                words.append(w)
                owners.append(t)
        for t, s in zip(owners, window_scores(words, self.weight, self.bias).tolist(), strict=True):
            if s > self[t]:
                self[t] = s


#: The worker's scores by model; workers are reused, so they outlive a task.
_known: dict[str, TokenScores] = {}


def text_features(scores: np.ndarray) -> tuple[float, ...]:
    """Of a text's different tokens: largest and second-largest window, softened sum and number of insulting ones."""
    top = np.sort(np.clip(np.partition(np.r_[scores, NOTHING, NOTHING], -2)[-2:], -1, 1))
    return float(top[1]), float(top[0]), float(np.log1p(np.maximum(scores, 0).sum())), float(np.log1p((scores > SURE).sum()))


def score_features(docs: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, f0 to f3) of every text."""
    shared, name = docs.sparkSession.sparkContext.broadcast((weight, bias)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _known:
            _known.clear()
            _known[name] = TokenScores(*shared.value)
        known = _known[name]
        for batch in batches:
            features = []
            for lo in range(0, batch.num_rows, 100):
                texts = [list(dict.fromkeys(tokens_of(t.as_py()))) for t in batch.column(1).slice(lo, 100)]
                known.learn(texts)
                features += [text_features(np.fromiter(map(known.__getitem__, t), np.float32, len(t))) for t in texts]
            cols = np.array(features, np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(cols[:, i]) for i in range(4))], names=["doc_id", "f0", "f1", "f2", "f3"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f0 double, f1 double, f2 double, f3 double")


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column is the bias."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], c * weight[inside]
        h = (xi * ci[:, None]).T @ xi + np.diag(ridge)
        new = np.linalg.solve(h, xi.T @ (ci * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def disguised(words: list[str], seed: int = 3) -> list[str]:
    """Each longer word once with a letter inserted and once with one doubled."""
    r = np.random.default_rng(seed)
    out = []
    for w in words:
        if len(w) >= 5:
            i, j = int(r.integers(1, len(w))), int(r.integers(1, len(w) - 1))
            out += [w[:i] + chr(97 + int(r.integers(26))) + w[i:], w[: j + 1] + w[j:]]
    return out


def _spread(words: list[str], count: int) -> list[str]:
    """Farthest-first choice of landmarks among all the words: each next one is the least like those chosen so far."""
    if len(words) <= count:
        return words
    blocks, near, chosen = list(by_length(words)), np.full(len(words), -np.inf), [0]
    for _ in range(count - 1):
        features = kernel_features([words[chosen[-1]]])[0]
        for at, found, weights, norm in blocks:
            near[at] = np.maximum(near[at], features[found] @ weights / norm)
        chosen.append(int(np.argmin(near)))
    return [words[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict | None:
    """The model, from (doc_id, text) and the learning rows of (doc_id, toxic); None if one kind is missing."""
    single = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for kind, most in ((1, max_toxic), (0, max_clean)):
        some = single.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "toxic-learn")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = tokens_of(text.as_py())
                pairs = sorted({(w, before) for before, t in zip(["", *tokens], tokens, strict=False) for w in windows_of(t)})
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)] + [pa.array([toxic] * len(pairs), pa.int32())], names=["word", "before", "toxic"])

    # A window counts once for each token it follows: copies of a text, which repeat its neighbours, add nothing.
    uses = texts.select("text", "toxic").mapInArrow(split, "word string, before string, toxic int")
    counted = uses.groupBy("word", "before").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c")).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = written(counted, "toxic-words")
    whole = counted.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not whole.t or not whole.c:
        return None
    base = whole.t / (whole.t + whole.c)
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    part = lambda x, share: F.when(x > 0, x * F.ln(x / n / share)).otherwise(0.0)
    counted = counted.withColumn("ratio", F.when(t / n > base, 2 * (part(t, base) + part(c, 1 - base))).otherwise(0.0))
    rows = counted.filter((F.col("ratio") >= WITNESS) & (t / n >= PURITY)).orderBy(F.col("ratio").desc(), "word").limit(MAX_WINDOWS).collect()
    clean = counted.filter((t == 0) & (c > 0))
    common = clean.orderBy(F.col("c").desc(), "word").limit(MAX_WINDOWS // 2).collect()
    rest = clean.orderBy(F.xxhash64("word"), "word").limit(MAX_WINDOWS).collect()
    mixed = counted.filter((c > 0) & (t > 0) & (F.col("ratio") < 2)).orderBy(n.desc(), "word").limit(MAX_WINDOWS // 2).collect()
    good = list(dict.fromkeys(r.word for r in [*common, *mixed, *rest]))
    bad = [r.word for r in rows]
    bad = list(dict.fromkeys(bad + disguised(bad)))
    if not bad or not good:
        return None
    z_bad = _spread(bad, LANDMARKS * 5 // 8)
    z_good = _spread(good, LANDMARKS - len(z_bad))
    phi = kernel_features(z_bad + z_good)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-4 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    columns = np.ascontiguousarray(phi.T)

    def machine(good: list[str]) -> tuple[np.ndarray, float]:
        y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
        balance = np.where(y > 0, len(y) / (2 * len(bad)), len(y) / (2 * len(good)))
        w = train_svm(against(bad + good, columns) @ whiten, y, balance)
        return (phi.T @ (whiten @ w[:-1])).astype(np.float32), float(w[-1])

    first = machine(good)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(window_scores(words, *first), pa.float32())], names=["word", "s"])

    # Windows of clean texts that the first machine finds most insulting teach the second.
    hard = clean.select("word").mapInArrow(rate, "word string, s float").orderBy(F.col("s").desc(), "word").limit(MAX_WINDOWS // 2).collect()
    weight, bias = machine(list(dict.fromkeys([*good, *(r.word for r in hard)])))
    got = score_features(texts, weight, bias).join(F.broadcast(picked), "doc_id").select("f0", "f1", "f2", "f3", "toxic").toPandas()
    f, target = got[["f0", "f1", "f2", "f3"]].to_numpy(), got["toxic"].to_numpy()
    return {"weight": weight, "bias": bias, "curve": logistic(f, target)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every text."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    w = [float(v) for v in model["curve"]]
    line = sum((F.col(f"f{i}") * w[i] for i in range(4)), F.lit(w[4]))
    return score_features(docs, model["weight"], model["bias"]).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = score(docs, fit(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
