"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, length normalisation."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import CHUNK_BYTES, cut, map_arrow, prepared, read, released, sample_of

#: Labelled rows that the lexicon is learned from at most, and bytes of their texts (a sample by the id's hash; documented bounds).
FIT_ROWS, FIT_BYTES = 12_000, 32 << 20
#: Look-alikes from Cyrillic, Greek and full-width letters, then digits and signs used as letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
FULL_WIDTH = {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF21 + k): chr(97 + k) for k in range(26)}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_FOLD = str.maketrans(HOMOGLYPHS | FULL_WIDTH | {c: None for c in ZERO_WIDTH} | {k.upper(): v for k, v in HOMOGLYPHS.items() if k.upper() != k})
_DIGITS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?=[^\W\d_]*[\d@$!])(?=[\d@$!]*[^\W\d_])[\w@$!]*\w")
_BREAK = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case with homoglyphs as Latin letters; digits and signs inside a word with letters become letters.

    Words come out separated by single spaces, with a space at either end.
    """
    text = text.lower().translate(_FOLD)
    if any(c in text for c in SUBSTITUTES):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGITS), text)
    return f" {_BREAK.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights (words when they end in a space, else beginnings of words), exceptions, and the logistic scale."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -2.2
    slope: float = 1.0
    _automaton: object = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.bias, self.slope

    def __setstate__(self, state):
        self.terms, self.exceptions, self.bias, self.slope = state
        self._automaton = None

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                a.add_word(f" {term}", (len(term) + 1, weight))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def evidence(self, folded: str) -> tuple[float, int]:
        """Total weight and number of matched words; of terms that begin at one word the longest counts.

        A match inside an exception phrase doesn't count.
        """
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if self.terms or self.exceptions:
            for end, (length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif start not in best or best[start][0] < length:
                    best[start] = (length, weight)
        weights = [w for s, (n, w) in best.items() if not any(a <= s and s + n - 2 <= b for a, b in spared)]
        return sum(weights), len(weights)

    def score(self, text: str | None) -> float:
        """0 to 1: a logistic of the evidence for each root of the words' number, so length alone says nothing."""
        return logistic(self.bias + self.slope * self.feature(text))

    def feature(self, text: str | None) -> float:
        return self.feature_of(fold(text or ""))

    def feature_of(self, folded: str) -> float:
        total, _ = self.evidence(folded)
        return total / math.sqrt(1.0 + folded.count(" ") / 100.0)


def logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def learn(texts: list[str | None], toxic: list[int], least: int = 4, ratio: float = 2.0) -> Lexicon:
    """A lexicon from labelled texts: words and beginnings of words that are far more frequent in toxic texts.

    Weights are log odds with half a text added. A phrase of a term and its neighbour that toxic texts don't have
    is an exception. The logistic is fitted to the same texts. Without both labels the lexicon is empty.
    """
    return learn_folded([fold(t or "") for t in texts], toxic, least, ratio)


def learn_folded(folded: list[str], toxic: list[int], least: int = 4, ratio: float = 2.0) -> Lexicon:
    """``learn`` of texts that are folded already."""
    counts = [len(toxic) - sum(map(bool, toxic)), sum(map(bool, toxic))]
    if not all(counts):
        return Lexicon({}, bias=-2.2 if counts[0] or not counts[1] else 2.2)
    with_it = Counter()
    for text, label in zip(folded, toxic, strict=True):
        if label:
            with_it.update({p for w in set(text.split()) for p in (f"{w} ", *(w[:k] for k in range(4, min(8, len(w)) + 1)))})
    with_it = Counter({t: n for t, n in with_it.items() if n >= least})
    without = Counter()  # only of terms that can be chosen: the clean texts' others are many
    for text, label in zip(folded, toxic, strict=True):
        if not label:
            found = set()
            for w in set(text.split()):
                # a word's first four letters are as frequent as any longer part of it
                if len(w) < 4 or w[:4] in with_it:
                    found.update(p for p in (f"{w} ", *(w[:k] for k in range(4, min(8, len(w)) + 1))) if p in with_it)
            without.update(found)
    odds = lambda term: math.log((with_it[term] + 0.5) / (counts[1] + 1)) - math.log((without[term] + 0.5) / (counts[0] + 1))
    terms = {}
    for term, n in with_it.items():
        if (w := odds(term)) >= ratio:
            terms[term] = w
    # a longer term says no more than a beginning of it that is as pure
    lean = {}
    for term, w in terms.items():
        stem = term.rstrip()
        shorter = [stem[:k] for k in range(4, len(stem) + (term[-1] == " ")) if stem[:k] in terms and stem[:k] != term]
        if not any(terms[s] >= w - 0.3 for s in shorter):
            lean[term] = w
    lexicon = Lexicon(lean)
    stems = {t.rstrip() for t in lean}
    pairs_with, pairs_without = Counter(), Counter()
    heads = {s[:3] for s in stems}
    for text, label in zip(folded, toxic, strict=True):
        names = text.split()
        hit = [(w[:3] in heads or w[:2] in heads) and any(w[:k] in stems for k in range(2, len(w) + 1)) for w in names]
        near = {f"{a} {b}" for a, b, x, y in zip(names, names[1:], hit, hit[1:]) if x or y}
        (pairs_with if label else pairs_without).update(near)
    lexicon.exceptions = {p for p, n in pairs_without.items() if n >= least and n > 20 * pairs_with[p] * counts[0] / counts[1]}
    x = np.array([lexicon.feature_of(t) for t in folded])
    lexicon.slope, bias = fit_logistic(x, np.array(toxic, float))
    lexicon.bias = min(bias, -0.05)  # a text without evidence is never called toxic
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * len(x) * np.eye(2) * 0.01, a.T @ (y - p) - ridge * 0.01 * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5 (a null id counts as '')."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = FIT_BYTES) -> list:
    """(doc_id, text, y) of labelled rows that aren't held out: ``most`` of them and ``most_bytes`` of text at most.

    Those with the smallest hash of their id are taken, while there is room. Rows with a null text, id or label are left
    out, and so are texts that are longer than an eighth of the room; of an id's several rows one counts. Only the
    chosen rows' texts move.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).dropDuplicates(["doc_id"])
    ids = [(r["doc_id"], r["y"], k) for k, r in enumerate(sample_of(known, most, "doc_id").collect())]
    if not ids:
        return []
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes // 8)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids_df = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int, k int"))  # ``most`` rows at most
    named = texts.join(ids_df, "doc_id").select("k", "doc_id", "y", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    chosen, room = [], most_bytes
    for r in sorted(named.groupBy("k", "doc_id", "y").agg(F.min(F.struct("h", "size")).alias("m")).collect()):
        room -= r["m"]["size"]
        if room >= 0:
            chosen.append((r["doc_id"], r["y"], r["m"]["h"]))
    if not chosen:
        return []
    chosen_df = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int, h long"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(chosen_df, ["doc_id", "h"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return sorted(rows.select("doc_id", "text", "y").collect(), key=lambda r: r["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Lexicon:
    """The lexicon of the documents' labels (column ``toxic``), from at most ``most`` rows that aren't held out."""
    rows = training_rows(docs, labels, "toxic", most)
    toxic, folded = [r["y"] for r in rows], []
    while rows:  # a text goes when it is folded
        folded.append(fold(rows.pop()["text"]))
    return learn_folded(folded[::-1], toxic)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of each whole text; null and empty texts have the score of no evidence."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": [lexicon.score(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, with all their columns and in any number of repeated rows.

    A null or empty text has the score of no evidence, and so stays, unless all labels there are say toxic.
    Ids and other columns may be null; an empty table gives no rows, and without labels all documents stay.
    """
    prepared(spark)
    lexicon = fit(docs, read(spark, sf_dir, "labels"))

    def keep(batches):
        for batch in batches:
            for part in cut(batch, CHUNK_BYTES):
                clean = [lexicon.score(t) < 0.5 for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
