"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text, their leading 4 to 7 bytes, and the order of magnitude of the text's length, each hashed to one of
2**18 buckets and taken once a text. The score is sigmoid(w0 + sum w[i] + sum over pairs <v[i], v[j]>), the pairs summed in
linear time as (|sum v|**2 - sum |v|**2) / 2; so a pair of terms can mean more than both alone.

The model is fitted on at most ``sample`` labelled texts (chosen by a hash of doc_id; whole texts) by AdaGrad with sparse updates, in two turns: first the
terms whose share of texts differs clearly between the labels, which finds a good start from few texts; then, from there, all parameters of all
buckets together. No term is left out, so one that means something only beside another is learned as well. Every text is scored whole.

Defined results: a null or empty text has only the length term and gets a score like any other; labels that are null, or of
documents that are not there, teach nothing; a doc_id labelled both ways counts as toxic; without labels of both kinds every score
is the share of toxic ones (0 without labels); rows that repeat are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alluvia.llm import words as W

U = np.uint64
BITS, SAMPLE, FACTORS = 18, 40_000, 4
PREFIXES = (4, 5, 6, 7)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term, with repeats."""
    w = W.find(data, offsets, W.ALNUM, True)
    up, down = W.BYTES.upto(len(w.data) + 1)
    sums = np.zeros(len(w.data) + 1, dtype=U)
    np.cumsum((w.data.astype(U) + U(1)) * up[: len(w.data)], out=sums[1:])
    text = w.text_of()
    size = w.ends - w.starts
    of, found = [text], [W.mix((sums[w.ends] - sums[w.starts]) * down[w.starts])]
    for n in PREFIXES:
        s = w.starts[size > n]
        of.append(text[size > n])
        found.append(W.mix((sums[s + n] - sums[s]) * down[s] + U(n << 32)))
    lengths = np.log2(np.diff(w.of) + 1).astype(U)
    of.append(np.arange(len(lengths)))
    found.append(W.mix(lengths + U(1 << 40)))
    return np.concatenate(of), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def once(text: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text * width + term)
    return both // width, both % width


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(text, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            z += (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The buckets whose shares differ by three standard errors, seen in three texts at least: those that are fitted first."""
    both = toxic + clean
    share = both / (n_toxic + n_clean)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_clean))
    return np.flatnonzero((both >= 3) & (np.abs(toxic / n_toxic - clean / n_clean) >= 3 * error))


def fit_all(texts: list[np.ndarray], labels: np.ndarray, n_terms: int, factors: int = FACTORS) -> tuple[float, np.ndarray, np.ndarray]:
    """Both turns."""
    n_toxic = int(labels.sum())
    toxic = sum((np.bincount(t, minlength=n_terms) for t, y in zip(texts, labels) if y), np.zeros(n_terms))
    clean = sum((np.bincount(t, minlength=n_terms) for t, y in zip(texts, labels) if not y), np.zeros(n_terms))
    first = telling(toxic, clean, n_toxic, len(texts) - n_toxic)
    start = None
    if len(first):
        place = np.full(n_terms, -1)
        place[first] = np.arange(len(first))
        bias, some, pairs = fit([p[p >= 0] for p in (place[t] for t in texts)], labels, len(first), factors)
        w, v = np.zeros(n_terms), np.random.default_rng(7).normal(0, 0.02, (n_terms, factors))
        w[first], v[first] = some, pairs
        start = bias, w, v
    return fit(texts, labels, n_terms, factors, epochs=3, rate=0.1 if start is None else 0.005, calm=1e-3, start=start)


def fit(texts: list[np.ndarray], labels: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, seed: int = 7, calm: float = 1e-6, start: tuple | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    share = labels.mean()
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n_terms), g.normal(0, 0.02, (n_terms, factors))
    bias, w, v = start or (bias, w, v)
    gw, gv, gb = np.full(n_terms, calm), np.full((n_terms, factors), calm), calm  # so that a term seen once moves little
    for _ in range(max(epochs, -(-300 * 64 // len(texts)))):  # 300 steps at least, however few the texts
        order = g.permutation(len(texts))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            own = [texts[i] for i in some]
            text, term = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
            n = len(own)
            x = v[term]
            sums = np.stack([np.bincount(text, x[:, f], n) for f in range(factors)], axis=1)
            squares = np.bincount(text, (x * x).sum(axis=1), n)
            z = bias + np.bincount(text, w[term], n) + ((sums**2).sum(axis=1) - squares) / 2
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / n
            seen, at = np.unique(term, return_inverse=True)
            dw = np.bincount(at, slope[text]) + l2 * w[seen]
            part = slope[text, None] * (sums[text] - x)
            dv = np.stack([np.bincount(at, part[:, f]) for f in range(factors)], axis=1) + l2 * v[seen]
            gb += slope.sum() ** 2
            gw[seen] += dw**2
            gv[seen] += dv**2
            bias -= rate * slope.sum() / gb**0.5
            w[seen] -= rate * dw / np.sqrt(gw[seen])
            v[seen] -= rate * dv / np.sqrt(gv[seen])
    return bias, w, v


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """``labels``: doc_id and toxic of the rows that may teach."""
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = given.count()
    chosen = given.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, total)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("toxic", "text")  # the sample bounds what is broadcast

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, data, offsets in W.slices(batch.column(1)):
                text, term = once(*terms(data, offsets), 1 << BITS)
                cuts = np.searchsorted(text, np.arange(1, len(offsets) - 1))
                out += [x.astype(np.int32).tobytes() for x in np.split(term, cuts)]
            yield pa.RecordBatch.from_arrays([(batch.column(0).to_numpy() == 1).astype(np.int32), pa.array(out, pa.binary())], names=["toxic", "terms"])

    found = rows.mapInArrow(reduced, "toxic int, terms binary").toArrow()
    texts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in found.column("terms")]
    toxic = found.column("toxic").to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (texts[i].tobytes(), toxic[i]))  # the order of arrival must not matter
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Machine(float(np.log((share + 1e-17) / (1 - share + 1e-17))), np.zeros(1 << BITS), np.zeros((1 << BITS, 1)))
    return Machine(*fit_all([texts[i] for i in order], toxic[order].astype(float), 1 << BITS))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, data, offsets in W.slices(batch.column(1)):
                n = len(offsets) - 1
                p = m.score(*once(*terms(data, offsets), 1 << BITS), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, score double")
