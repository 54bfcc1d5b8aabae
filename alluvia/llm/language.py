"""Language by rank order: the most frequent letter n-grams of a text against those of each language.

n-grams are of one to three letters, lower-cased, words padded at both ends; a profile is the ``size`` most frequent ones in order.
The distance of a text to a language is the sum, over the text's profile, of how far each n-gram is out of place, ``size`` if the
language's profile lacks it. Equal counts share their mean rank, so a short text's ranks depend on no arbitrary order.

Profiles are learned from at most ``sample`` labelled texts a language (chosen by a hash of doc_id, whole texts); the number of
languages is that of the label's values. Prediction reads every text whole.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing is learned; the nearest
language wins, of equally near ones the first by name; score is 1 less the distance as a part of the greatest possible one;
null labels teach nothing; rows that repeat are treated alike; empty tables give no rows; other columns are ignored or, by
``predict`` with ``keep``, carried along.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alluvia.llm import words as W

SIZE, SAMPLE, PAD = 400, 4000, 1
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 a letter, 1 a mark (which belongs to its letter), 0 anything else."""
    if not _KINDS:
        _KINDS.append(np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1))
    return _KINDS[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) and counts of the n-grams of a text."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds()[c] if len(c) else np.zeros(0, dtype=np.uint8)
    inside = kind > 0
    if not (kind == 2).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.concatenate([[PAD], np.where(inside, c, PAD), [PAD]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != PAD) | (c[:-1] != PAD)])]
    two = c[:-1] | c[1:] << 21
    three = (two[:-1] | c[2:] << 42)[c[1:-1] != PAD]
    return np.unique(np.concatenate([c[c != PAD], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes (least code first among equals) and their ranks, equal counts at their mean rank."""
    order = np.lexsort((codes, -counts))[:size]
    n = counts[order]
    edges = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1], [True]]))
    mean = (edges[:-1] + edges[1:] - 1) / 2
    return codes[order], np.repeat(mean, np.diff(edges))


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most about ``sample`` rows of each language."""
    sizes = labelled.groupBy("lang").count().withColumn("limit", F.least(F.lit(1.0), F.lit(sample) / F.col("count")))
    return labelled.join(F.broadcast(sizes.select("lang", "limit")), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.col("limit") * (1 << 20))


def learn(labelled: DataFrame, size: int = SIZE, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Profiles by language from columns doc_id, text, lang: codes in ascending order and their ranks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        totals: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = totals.setdefault(lang, {})
                for code, n in zip(*(x.tolist() for x in grams(text.as_py()))):
                    own[code] = own.get(code, 0) + n
        for lang, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "code", "n"])

    rows = sampled(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), sample)
    totals = rows.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list] = {}
    for r in totals.withColumn("place", place).filter(F.col("place") <= size).select("lang", "code", "n").collect():
        profiles.setdefault(r["lang"], []).append((r["code"], r["n"]))
    out = {}
    for lang, found in sorted(profiles.items()):
        codes, ranks = ranked(np.array([c for c, _ in found]), np.array([n for _, n in found]), size)
        order = np.argsort(codes)
        out[lang] = (codes[order], ranks[order])
    return out


def nearest(text: str | None, profiles: dict[str, tuple[np.ndarray, np.ndarray]], size: int) -> tuple[str, float]:
    codes, counts = grams(text)
    if not len(codes) or not profiles:
        return "und", 0.0
    codes, ranks = ranked(codes, counts, size)
    best, least = "und", float("inf")
    for lang, (known, places) in profiles.items():
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        distance = float(np.where(known[at] == codes, np.minimum(np.abs(places[at] - ranks), size), size).sum())
        if distance < least:
            best, least = lang, distance
    return best, 1 - least / (size * len(codes))


def predict(docs: DataFrame, profiles: dict[str, tuple[np.ndarray, np.ndarray]], size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id, unless given) of every row, with lang_pred and score."""
    kept = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    named = docs.select(*kept, F.col("text").alias("__text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        known = shared.value
        for batch in batches:
            found = [nearest(x.as_py(), known, size) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*kept, "lang_pred", "score"])
        W.release()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in named.schema.fields[:-1]) + "lang_pred string, score double"
    return named.mapInArrow(make, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
