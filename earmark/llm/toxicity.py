"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so tokens are labelled first: features (a word, its first four to six characters) that stand in
toxic documents far more often than in clean ones are looked for, by a log-likelihood ratio, which holds at a count of zero too; in a toxic document a word with such a feature is labelled
toxic, in a clean document no word is. The field has two tags, weights for the features of a word and of its neighbours, and
for each change of tag; it is fitted by gradient ascent of the log likelihood with forward-backward marginals. A document's
score is a logistic function of the largest marginal, their sum and their share of the words.

Chains are stretches around words with features; words more than ``GAP`` away from any carry no evidence and are left out.

Fitted on a bounded sample: at most about ``SAMPLE`` documents of each label, drawn by a hash of the id, of ``MOST_CHARS`` characters in all, and
``FEATURES`` features. An id of several rows teaches by one of its texts, the least by hash. Every document is scored over its whole text.

Defined results: null and empty texts score like any text without evidence; repeated rows score alike; null ids are scored;
of several labels of one id the largest counts; without any toxic or clean training document the score is the toxic share of
the training labels (0 without labels). Very long texts are scored whole; features of equal ratios are kept by name. Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import keyed, keyed_texts, pieces, pin, raw_texts, words

SAMPLE = 4000
#: Characters of all texts that teach; of longer ones a share is drawn, so that what reaches the driver is bounded.
MOST_CHARS = 64_000_000
FEATURES = 5000
#: Least log-likelihood ratio G2 of a feature: chi-squared with one degree of freedom, p about 0.00007.
LEAST_G2, LEAST_DOCS = 16.0, 3
GAP = 8
STRETCH = 64
#: Marginal from which an offset is reported.
SPAN = 0.5
#: Places of the chains that go through the field together; one longer chain goes alone.
CELLS = 1 << 16
_MEMO = 300_000
_STRIP = b".,;:!?\"'()[]"


def features_of(word: bytes) -> list[bytes]:
    word = word.strip(_STRIP)
    return [b"=" + word, *[b"^%d" % n + word[:n] for n in (4, 5, 6) if len(word) > n]] if word else []


@dataclass
class Crf:
    """Feature ids by name, and weights of the toxic tag for own, previous and next word; the other tag has weight 0."""

    ids: dict[bytes, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    change: np.ndarray  # 2 x 2, and the first tag in row 2
    doc: np.ndarray
    scale: np.ndarray
    share: float

    def __post_init__(self):
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def chains(self, tokens: list[bytes]) -> list[tuple[int, list[tuple[int, ...]]]]:
        """Start and feature ids by word of each stretch with evidence."""
        memo = self.memo
        fresh = set(tokens).difference(memo)
        if fresh:
            if len(memo) + len(fresh) > _MEMO:
                memo.clear()
                fresh = set(tokens)
            get = self.ids.get
            for w in fresh:
                memo[w] = tuple(i for i in map(get, features_of(w)) if i is not None)
        found = list(map(memo.__getitem__, tokens))
        at = [i for i, f in enumerate(found) if f]
        out, start = [], 0
        while start < len(at):
            stop = start
            while stop + 1 < len(at) and at[stop + 1] - at[stop] <= GAP:
                stop += 1
            low, high = max(0, at[start] - 1), min(len(tokens), at[stop] + 2)
            out.append((low, found[low:high]))
            start = stop + 1
        return out

    def potentials(self, chains: list[list[tuple[int, ...]]], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the toxic tag and mask, chain by place."""
        weight, mask = np.zeros((len(chains), length + 2)), np.zeros((len(chains), length), bool)
        for row, chain in enumerate(chains):
            mask[row, : len(chain)] = True
            for t, ids in enumerate(chain):
                for i in ids:
                    weight[row, t + 1] += self.own[i]
                    weight[row, t + 2] += self.before[i]
                    weight[row, t] += self.after[i]
        return weight[:, 1:-1], mask

    def marginals(self, weight: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the toxic tag, of each change of tag (chain, place, from, to), and log normaliser; forward-backward."""
        n, length = weight.shape
        step = self.change[:2]
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        emit = np.stack([np.zeros_like(weight), weight], axis=2)
        alpha[:, 0] = self.change[2] + emit[:, 0]
        for t in range(1, length):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + step[0], alpha[:, t - 1, 1, None] + step[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(length - 2, -1, -1):
            later = emit[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(step[:, 0] + later[:, 0, None], step[:, 1] + later[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t])
        toxic = np.where(mask, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None], 0)), 0.0)
        pair = alpha[:, :-1, :, None] + step[None, None] + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None]
        change = np.where(mask[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0.0)
        return toxic, change, whole

    def odds(self, chains: list[list[tuple[int, ...]]]) -> np.ndarray:
        """Marginals of the toxic tag, chain by place: :meth:`marginals` as log odds of the two tags, so that a step is one number."""
        weight, mask = self.potentials(chains, max(map(len, chains)))
        (stay, to), (back, keep) = self.change[:2]
        forth, since = np.empty(weight.T.shape), np.empty(weight.T.shape)
        weight, mask = np.ascontiguousarray(weight.T), np.ascontiguousarray(mask.T)
        forth[0] = self.change[2, 1] - self.change[2, 0] + weight[0]
        for t in range(1, len(weight)):
            x = forth[t - 1]
            forth[t] = np.logaddexp(to, keep + x) - np.logaddexp(stay, back + x) + weight[t]
        since[-1] = 0
        for t in range(len(weight) - 2, -1, -1):
            x = since[t + 1] + weight[t + 1]
            since[t] = (np.logaddexp(back, keep + x) - np.logaddexp(stay, to + x)) * mask[t + 1]
        return (1 / (1 + np.exp(-np.clip(forth + since, -700, 700)))).T

    def tag(self, texts: list[list[tuple[int, list[tuple[int, ...]]]]]) -> list[list[tuple[int, float]]]:
        """For the chains of each text, (word number, marginal) of the words that carry evidence. Chains of like length go together."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        waiting = sorted(((len(chain), k, low, chain) for k, chains in enumerate(texts) for low, chain in chains), key=lambda x: x[:3])
        start = 0
        while start < len(waiting):
            stop = start + 1
            while stop < len(waiting) and (stop - start + 1) * waiting[stop][0] <= CELLS:
                stop += 1
            block = waiting[start:stop]
            for (_, k, low, chain), row in zip(block, self.odds([x[3] for x in block]).tolist()):
                out[k] += [(low + t, p) for t, (p, ids) in enumerate(zip(row, chain)) if ids]
            start = stop
        return [sorted(found) for found in out]

    def score(self, marginals: list[float], n_words: int) -> float:
        if not len(self.doc):
            return self.share
        return float(1 / (1 + np.exp(-np.clip(_summary(marginals, n_words) / self.scale @ self.doc, -30, 30))))


def _summary(marginals: list[float], n_words: int) -> np.ndarray:
    """What a document's score is made of."""
    total = sum(marginals)
    return np.array([1.0, max(marginals, default=0.0), np.log1p(total), 100 * total / (n_words + 20)])


def _adam(gradient, parameters: list[np.ndarray], rounds: int, rate: float) -> None:
    """Ascent in place."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for k in range(1, rounds + 1):
        for p, g, m, v in zip(parameters, gradient(), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)


class _Group:
    """Chains of like length as matrices."""

    def __init__(self, model: Crf, chains: list[list[tuple[int, ...]]], tags: list[list[bool]]):
        self.length = max(map(len, chains))
        self.size = len(chains)
        self.truth = np.zeros((self.size, self.length))
        self.mask = np.zeros((self.size, self.length), bool)
        for row, t in enumerate(tags):
            self.truth[row, : len(t)], self.mask[row, : len(t)] = t, True
        entries = [(row, t, i) for row, chain in enumerate(chains) for t, ids in enumerate(chain) for i in ids]
        self.row, self.place, self.feature = (np.array(x, np.int64) for x in zip(*entries))
        tag, both = (1 - self.truth, self.truth), self.mask[:, 1:]
        self.seen = np.array([[(tag[i][:, :-1] * tag[j][:, 1:] * both).sum() for j in (0, 1)] for i in (0, 1)] + [[tag[i][:, 0].sum() for i in (0, 1)]])

    def gradient(self, model: Crf) -> list[np.ndarray]:
        cell, wide = self.row * (self.length + 2) + self.place, self.size * (self.length + 2)
        weight = sum(np.bincount(cell + step, values[self.feature], wide) for values, step in ((model.own, 1), (model.before, 2), (model.after, 0)))
        weight = weight.reshape(self.size, -1)
        toxic, change, _ = model.marginals(weight[:, 1:-1], self.mask)
        gap = np.pad(self.truth - toxic, ((0, 0), (1, 1)))
        sums = [np.bincount(self.feature, gap[self.row, self.place + step], len(model.own)) for step in (1, 2, 0)]
        return [*sums, self.seen - np.vstack([change.sum(axis=(0, 1)), [self.size - toxic[:, 0].sum(), toxic[:, 0].sum()]])]


def _fit_field(model: Crf, chains: list[list[tuple[int, ...]]], tags: list[list[bool]], rounds: int = 100) -> None:
    order = sorted(range(len(chains)), key=lambda k: (len(chains[k]), chains[k], tags[k]))
    groups = [_Group(model, [chains[k] for k in order[at : at + 2000]], [tags[k] for k in order[at : at + 2000]]) for at in range(0, len(order), 2000)]
    parameters = [model.own, model.before, model.after, model.change]

    def gradient() -> list[np.ndarray]:
        whole = [-0.05 * p for p in parameters]
        for group in groups:
            whole = [w + g for w, g in zip(whole, group.gradient(model))]
        return [w / len(chains) for w in whole]

    _adam(gradient, parameters, rounds, 0.1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE,
        most_chars: int = MOST_CHARS) -> Crf:
    """Learn from the documents that ``labels`` names (1: toxic, 0: clean)."""
    spark = docs.sparkSession
    told = keyed(labels, label_key, label).filter(F.col("_c0").isNotNull() & F.col("_c1").isin(0, 1)).groupBy("_c0").agg(F.max("_c1").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    none = np.zeros(0)
    model = Crf({}, none, none, none, np.zeros((3, 2)), none, none, share)
    if len(size) < 2:
        return model
    limit = F.when(F.col("toxic") == 1, F.lit(sample / size[1])).otherwise(F.lit(sample / size[0]))
    drawn = told.filter(F.pmod(F.xxhash64("_c0"), F.lit(1_000_000)) < limit * 1_000_000).withColumnRenamed("_c0", "id")
    # About ``sample`` ids of each label: the size of what is broadcast is bounded by that parameter.
    # Written, as three passes follow that needn't read the corpus again.
    # An id teaches by one text, however many rows it has.
    found = keyed_texts(docs, key, text).join(F.broadcast(drawn), F.col("_c0") == F.col("id"))
    rows = pin(found.groupBy("id").agg(F.min_by(F.struct("_c1", "toxic"), F.xxhash64("_c1")).alias("r")).select("r._c1", "r.toxic"), "taught")
    chars = rows.agg(F.sum(F.length("_c1"))).first()[0] or 0
    if chars > most_chars:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(1), "_c1"), F.lit(1_000_000)) < int(1_000_000 * most_chars / chars))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for piece in pieces(batch):
                for raw, toxic in zip(raw_texts(piece.column(0)), piece.column(1).to_pylist()):
                    by[toxic].update({f for w in set(words(raw)) for f in features_of(w)})
                    by[toxic][b""] += 1
        names = list(by[0].keys() | by[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([by[1][f] for f in part]), pa.array([by[0][f] for f in part])], names=["feature", "a", "b"])

    counted = pin(rows.mapInArrow(count, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "features")
    whole = counted.filter(F.col("feature") == F.lit(b"")).first()
    if whole is None or not whole["a"] or not whole["b"]:
        return model
    toxic, clean = F.col("a").cast("double"), F.col("b").cast("double")
    n, m = float(whole["a"]), float(whole["b"])

    def part(seen: Column, of: float, all_seen: Column) -> Column:
        """Of documents of one label: those with the feature and those without it, against what both labels' share leads to expect."""
        return sum(F.when(x > 0, x * F.log(x / (of * y / (n + m)))).otherwise(0.0) for x, y in ((seen, all_seen), (F.lit(of) - seen, F.lit(n + m) - all_seen)))

    g2 = 2 * (part(toxic, n, toxic + clean) + part(clean, m, toxic + clean))
    more = toxic * m > clean * n
    kept = counted.filter((F.col("feature") != F.lit(b"")) & (F.col("a") >= LEAST_DOCS) & more & (g2 >= LEAST_G2)).select("feature", g2.alias("g2")).orderBy(F.desc("g2"), "feature").limit(FEATURES).collect()
    if not kept:
        return model
    model.ids = {bytes(r["feature"]): i for i, r in enumerate(kept)}
    model.own, model.before, model.after = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
    shared = spark.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out: dict[str, list] = {"toxic": [], "n": [], "chains": []}
                for raw, toxic in zip(raw_texts(piece.column(0)), piece.column(1).to_pylist()):
                    tokens = words(raw)
                    out["toxic"].append(toxic)
                    out["n"].append(len(tokens))
                    # Long chains teach in stretches, so that a few of them don't set the width of the matrices.
                    out["chains"].append([[list(f) for f in chain[k : k + STRETCH]] for _, chain in shared.value.chains(tokens) for k in range(0, len(chain), STRETCH)])
                yield pa.RecordBatch.from_arrays([pa.array(out["toxic"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["chains"], pa.list_(pa.list_(pa.list_(pa.int32()))))], names=list(out))

    taught = rows.mapInArrow(gather, "toxic int, n long, chains array<array<array<int>>>").toArrow().to_pylist()
    chains, tags = [], []
    for r in taught:
        for chain in r["chains"]:
            chains.append([tuple(f) for f in chain])
            tags.append([bool(f) and r["toxic"] == 1 for f in chain])
    if not chains:
        return model
    _fit_field(model, chains, tags)
    rows_x, truth = [], []
    for r, found in zip(taught, model.tag([[(STRETCH * k, [tuple(f) for f in chain]) for k, chain in enumerate(r["chains"])] for r in taught])):
        rows_x.append(_summary([p for _, p in found], r["n"]))
        truth.append(r["toxic"])
    x, y = np.array(rows_x), np.array(truth, float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    # Each label weighs as much as it does among all training labels.
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.doc = np.zeros(x.shape[1])

    def gradient() -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x / model.scale @ model.doc, -30, 30)))
        return [(x / model.scale).T @ (weight * (y - p)) / len(y) - 1e-4 * model.doc]

    _adam(gradient, [model.doc], 600, 0.1)
    return model


def toxic_spans(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, n_words, spans (word number, marginal; of marginals of at least SPAN) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for piece in pieces(batch):
                score, n, spans, chains = [], [], [], []
                for raw in raw_texts(piece.column(1)):
                    tokens = words(raw)
                    chains.append(field.chains(tokens))
                    n.append(len(tokens))
                for found, length in zip(field.tag(chains), n):
                    score.append(field.score([p for _, p in found], length))
                    spans.append([{"word": w, "marginal": p} for w, p in found if p >= SPAN])
                kind = pa.list_(pa.struct([("word", pa.int32()), ("marginal", pa.float64())]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(spans, kind)], names=["id", "score", "n_words", "spans"])

    return keyed_texts(docs, key, text).mapInArrow(run, "id long, score double, n_words int, spans array<struct<word: int, marginal: double>>")
