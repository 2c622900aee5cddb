"""Language identification by rank-order profiles.

A profile lists n-grams (1 to 3 letters of words with a border mark at either end) from the most frequent
down. A text is given to the language whose profile is nearest by out-of-place distance: the sum, over the
text's most frequent n-grams, of how far each stands from its place in the profile, with a fixed distance
for those that the profile lacks.

Profiles are learned from about ``SAMPLE`` labelled documents of each language (all if there are fewer),
chosen by a hash of their identifier; their whole texts count.

Results: lang_pred is ``und`` with score 0 for a null text, one without a letter, or where nothing was
learned. Very long texts count whole, a slice of letters at a time. The score is 1 less the distance as a share of the largest possible one. Languages at equal
distances: the first by name. Repeated rows are judged each; an empty table gives no rows; a null doc_id is
never learned from. Extra columns are not read, but for ``reject_unidentified``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.runtime import share_code, unused

#: Labelled documents of a language to learn from, about; n-grams of a profile.
SAMPLE, PROFILE = 1000, 300
#: A text that scores less is in none of the learned languages.
LEAST = 0.1
#: The mark of a word's border; bits of a letter in an n-gram's code; letters that are counted at a time.
BORDER, BITS, SLICE = 95, 21, 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text's words, by code.

    A code holds the letters from the highest bits down, so codes sort as the n-grams do.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    here = letters()[points]
    if not here.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Words with one border between them: what is no letter counts once, where it follows a letter.
    ends = ~here
    ends[1:] &= here[:-1]
    ends[0] = False
    c = np.where(here, points, BORDER)[here | ends].astype(np.int64)
    c = np.concatenate([[BORDER], c, [BORDER] if c[-1] != BORDER else []]).astype(np.int64)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = 0
    while low < len(c) - 1:
        high = len(c)
        if high - low > SLICE:
            high = low + SLICE
            stops = np.flatnonzero(c[low + 1 : high] == BORDER)
            later = np.flatnonzero(c[high:] == BORDER) if not len(stops) else stops
            high = (low + 2 + int(stops[-1])) if len(stops) else high + int(later[0]) + 1
        w = c[low:high]
        pairs = w[:-1] << BITS | w[1:]
        three = (pairs[:-1] << BITS | w[2:])[w[1:-1] != BORDER]
        every = np.sort(np.concatenate([w[w != BORDER] << 2 * BITS, pairs << BITS, three]))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        codes = np.concatenate([codes, every[first]])
        counts = np.concatenate([counts, np.diff(np.append(first, len(every)))])
        low = high - 1
        if len(codes) > len(first):
            codes, at = np.unique(codes, return_inverse=True)
            counts = np.bincount(at, counts).astype(np.int64)
    return codes, counts


def ranked(text: str) -> np.ndarray:
    """The codes of a text's most frequent n-grams, ties by code."""
    codes, counts = ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, dict[int, int]]:
    """Each language's n-grams with their places, from ``docs`` (doc_id, text, lang) that are not held out."""
    share_code(docs.sparkSession)
    fit = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    unit = 1 << 20
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(unit, -(-SAMPLE * unit // n)))])
    chosen = fit.where(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, found in by_lang.items():
                codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("place", place).where(F.col("place") <= PROFILE)
    out: dict[str, dict[int, int]] = {}
    for r in top.select("lang", "gram", "place").collect():  # a profile for each language
        out.setdefault(r["lang"], {})[r["gram"]] = r["place"] - 1
    return out


class Classifier:
    """Profiles as a table: a row for each language, a column for each n-gram of any profile."""

    def __init__(self, profiles: dict[str, dict[int, int]]):
        self.names = sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        #: Far beyond any place, so that a missing n-gram's distance is cut to the fixed one.
        self.places = np.full((len(self.names), len(self.codes) + 1), 2 * PROFILE, np.int64)
        for k, name in enumerate(self.names):
            for at, code in enumerate(self.codes.tolist()):
                self.places[k, at] = profiles[name].get(code, 2 * PROFILE)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score) of a text."""
        order = ranked(text or "")
        if not len(order) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, order)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != order] = len(self.codes)
        distance = np.minimum(np.abs(self.places[:, at] - np.arange(len(order))), PROFILE).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - int(distance[best]) / (PROFILE * len(order))


def predict(docs: DataFrame, keep: list[str], profiles: dict[str, dict[int, int]], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, the language and the score of ``text``."""
    share_code(docs.sparkSession)
    text = unused("v_text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles).classify
        for batch in batches:
            n = batch.num_columns - 1
            found = [classify(t.as_py()) for t in batch.column(n)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*batch.schema.names[:n], *names])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text)
    return source.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double")


def reject_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are ``und`` or score less than ``LEAST``."""
    profiles = learn(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles).classify
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != "und" and score >= LEAST for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
