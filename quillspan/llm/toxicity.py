"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings.  The vocabulary holds those that labelled
toxic examples use significantly more often than clean ones (log-likelihood
ratio); in that space each text is a TF-IDF vector.  Examples lie in blocks;
for every term a block stores its greatest weight, so that a search visits
blocks by their upper bound and stops when no block can hold a nearer example:
the nearest are exact.  Votes weighted by cosine, drawn towards the examples'
own rate, give the score; the nearest examples are its evidence.

What is fitted uses a bounded sample of labelled rows; document frequencies
cover all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.tables import cut

#: Labelled rows that are fitted on, at most (chosen by hash of doc_id, in expectation; see ``_sample``).
EXAMPLES = 40_000
#: Toxic examples a term must occur in, its log-likelihood ratio, and how many times as often as in clean ones.
LEAST_TOXIC, LEAST_RATIO, LEAST_LIFT = 3, 10.0, 5.0
NEAREST = 15
#: Weight of the examples' rate among the votes, in units of one example of cosine 1.
PRIOR = 0.5
BLOCK = 64
THRESHOLD = 0.3
#: Lengths of the word beginnings that are terms too.
BEGINNINGS = (4, 5)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(text: str) -> set[str]:
    """The distinct words of a text and, marked, their beginnings."""
    own = set(words(text))
    return own.union(*[{"^" + w[:n] for w in own if len(w) > n} for n in BEGINNINGS])


def ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Log-likelihood ratio of a term in a of n_a toxic and b of n_b clean examples; 0 if not far more frequent in toxic ones."""
    if a * n_b <= LEAST_LIFT * b * n_a:
        return 0.0
    rate = (a + b) / (n_a + n_b)

    def part(k: int, n: int) -> float:
        expected = n * rate
        return sum(x * math.log(x / e) for x, e in ((k, expected), (n - k, n - expected)) if x)

    return 2 * (part(a, n_a) + part(b, n_b))


class Model:
    """Vocabulary, weights and the block-max index of examples; small and bounded, so it can be broadcast."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray):
        self.weights = weights
        self.words = {t: i for i, t in enumerate(vocabulary) if t[0] != "^"}
        self.beginnings = {n: {t[1:]: i for i, t in enumerate(vocabulary) if t[0] == "^" and len(t) == n + 1} for n in BEGINNINGS}
        self.only_words = frozenset(self.words)
        self.labels = np.zeros(0)
        self.ids = np.zeros(0, np.int64)
        self.rate = self.without = 0.0
        self.found: dict[tuple, tuple] = {}

    def vector(self, text: str) -> tuple[tuple[int, float], ...]:
        """The unit TF-IDF vector as (term, weight), terms ascending; empty if no term occurs."""
        all_words = words(text)
        own = set(all_words)
        counts: dict[int, int] = {}
        hit = own & self.only_words
        for w, c in Counter([w for w in all_words if w in hit]).items() if hit else ():
            counts[self.words[w]] = c
        for n, known in self.beginnings.items():
            hit = {w[:n] for w in own if len(w) > n} & known.keys()
            for b, c in Counter([w[:n] for w in all_words if len(w) > n and w[:n] in hit]).items() if hit else ():
                counts[known[b]] = c
        raw = {i: (1 + math.log(c)) * self.weights[i] for i, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return tuple(sorted((i, x / norm) for i, x in raw.items())) if norm else ()

    def index(self, examples: list[tuple[int, int, tuple]], n_empty: int, toxic_empty: int) -> None:
        """Fills the index; examples with like strongest terms share blocks, which makes the bounds tight."""
        self.without = (toxic_empty + PRIOR * self.base(examples, n_empty, toxic_empty)) / (n_empty + PRIOR)
        examples = sorted(examples, key=lambda e: (max(e[2], key=lambda x: x[1]), e[0]))
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.labels = np.array([e[1] for e in examples], dtype=np.float64)
        self.rate = float(self.labels.mean()) if len(examples) else self.without
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, _, vector) in enumerate(examples):
            for t, x in vector:
                lists[t].append((k, x))
        self.blocks = -(-len(examples) // BLOCK)
        self.postings = {}
        for t, rows in lists.items():
            at = np.array([k for k, _ in rows])
            x = np.array([w for _, w in rows])
            block, begin = np.unique(at // BLOCK, return_index=True)
            self.postings[t] = (block, np.append(begin, len(at)), np.maximum.reduceat(x, begin), at, x)

    @staticmethod
    def base(examples, n_empty, toxic_empty) -> float:
        n = len(examples) + n_empty
        return (sum(e[1] for e in examples) + toxic_empty) / n if n else 0.0

    def nearest(self, vector: tuple[tuple[int, float], ...], k: int) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above 0 as (cosine, position); ties to the smaller position."""
        lists = [(w, *self.postings[t]) for t, w in vector if t in self.postings]
        bound = np.zeros(self.blocks)
        for w, block, _, most, _, _ in lists:
            bound[block] += w * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-9:
                break
            score = np.zeros(BLOCK)
            for w, block, begin, _, at, x in lists:
                i = int(np.searchsorted(block, b))
                if i < len(block) and block[i] == b:
                    part = slice(begin[i], begin[i + 1])
                    score[at[part] - b * BLOCK] += w * x[part]
            hit = np.flatnonzero(score)
            best = sorted([*best, *zip(score[hit].tolist(), (hit + b * BLOCK).tolist())], key=lambda e: (-e[0], e[1]))[:k]
        return best

    def score(self, text: str | None) -> tuple[float, str]:
        """Score and evidence: the three nearest examples as doc_id:label:cosine."""
        vector = self.vector(text) if text else ()
        if not vector or not len(self.ids):
            return self.without, ""
        if vector not in self.found:
            if len(self.found) > 20_000:
                self.found.clear()
            near = self.nearest(vector, NEAREST)
            total = sum(c for c, _ in near)
            votes = sum(c * self.labels[i] for c, i in near)
            evidence = ",".join(f"{self.ids[i]}:{int(self.labels[i])}:{c:.4f}" for c, i in near[:3])
            self.found[vector] = (min(1.0, float((votes + PRIOR * self.rate) / (total + PRIOR))), evidence)
        return self.found[vector]


def _near_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A one-hash sketch of each text's five-word shingles, alike for most near copies; short texts by all their words."""
    for batch in V.slices(batches, "text"):
        buf, offsets = V.raw(batch.column("text"), lower=True)
        starts, ends, first = V.word_bounds(buf, offsets)
        hashes = V.span_hashes(buf, starts, ends)
        at, owner = V.windows(first, 5)
        grams = V.window_hashes(hashes, 5)[at]
        sketch = V.totals(hashes, first, 3).view(np.uint64).copy()
        full, begin = np.unique(owner, return_index=True)
        if len(full):
            sketch[full] = np.minimum.reduceat(grams, begin)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch.view(np.int64))], names=[*batch.schema.names, "sketch"])


def _count_terms(known: frozenset | None = None):
    """Rows (term, n): in how many texts each term occurs; all terms, or the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = terms(text) if text else ()
                counts.update(found if known is None else known.intersection(found))
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    return run


def _sums(texts: DataFrame, known: frozenset | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(_count_terms(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _rated(n_toxic: int, n_clean: int):
    """The terms (term, a, b) that pass, with their ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = pa.array([ratio(a, b, n_toxic, n_clean) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())], pa.float64())
            rows = pa.RecordBatch.from_arrays([batch.column("term"), rates], names=["term", "rate"])
            yield rows.filter(pa.array([x >= LEAST_RATIO for x in rates.to_pylist()], pa.bool_()))

    return run


def _chosen(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The terms that pass; every term of LEAST_TOXIC toxic examples is tested, and all that pass are kept: the sample bounds them."""
    often = _sums(toxic).where(F.col("n") >= LEAST_TOXIC).withColumnRenamed("n", "a")
    counted = often.join(_sums(clean).withColumnRenamed("n", "b"), "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    passed = counted.where(F.col("a") * n_clean > F.lit(LEAST_LIFT) * F.col("b") * n_toxic).mapInArrow(_rated(n_toxic, n_clean), "term string, rate double")
    return sorted(r.term for r in passed.select("term").collect())


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts and labels of at most about ``most`` labelled rows that are not held out (a hash threshold, so within a few standard deviations)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    wide = 1 << 30
    part = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(wide)) < min(wide, wide * most // max(n, 1)))
    if part.count() > most + 10 * math.isqrt(most):
        raise ValueError("the sample of labelled rows is larger than its bound")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(texts.join(F.broadcast(part), "doc_id"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """A model from labelled rows that are not held out; without toxic ones it knows no term and scores the base rate."""
    sample = _sample(docs, labels, examples)
    sketched = sample.mapInArrow(_near_copies, "doc_id long, text string, toxic int, sketch long")
    # One example of each group of near copies counts for the choice of terms.
    one = sketched.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    single = cut(sample.join(one, "doc_id", "left_semi"), "single")
    toxic, clean = single.where("toxic = 1"), single.where("toxic <> 1")
    n_toxic, n_clean = toxic.count(), clean.count()
    chosen = _chosen(toxic, clean, n_toxic, n_clean)
    # Document frequencies over the whole corpus.
    n_docs = docs.count()
    frequency = {r.term: r.n for r in _sums(docs, frozenset(chosen)).collect()} if chosen else {}
    model = Model(chosen, np.array([math.log((1 + n_docs) / (1 + frequency.get(t, 0))) + 1 for t in chosen]))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.vector(t) if t else () for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([[i for i, _ in v] for v in rows], pa.list_(pa.int32())), pa.array([[x for _, x in v] for v in rows], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "weights"],
            )

    made = sample.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, weights array<double>")
    made = cut(made, "examples")
    empty = {r.toxic: r.n for r in made.where("size(terms) = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    full = [(r.doc_id, int(r.toxic == 1), tuple(zip(r.terms, r.weights))) for r in made.where("size(terms) > 0").collect()]
    model.index(full, sum(empty.values()), empty.get(1, 0))
    return model


def scorer(model: Model, spark) -> Column:
    """A pandas UDF from text to (score, evidence) with the broadcast model."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence string")
    def score(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t) for t in text], columns=["score", "evidence"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, evidence.

    Reads ``doc_id``, ``text`` and the labels' ``doc_id``, ``toxic``; repeated
    labels of a document count as its largest.  A null or empty text gets the
    rate of examples without any term.  A null ``doc_id`` is not held out.
    With no labels every score is 0.
    """
    score = scorer(fit(docs, labels, **options), docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("s"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, without the documents that score at or over the threshold."""
    score = scorer(fit(docs, labels, **options), docs.sparkSession)
    return docs.where(score("text")["score"] < THRESHOLD)
