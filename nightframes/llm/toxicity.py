"""Toxicity from a learned lexicon, with misspellings and the context of each hit.

The lexicon is learned from labelled documents: words and word stems that occur almost only
in toxic ones. A word of a text is a hit if it is a term or begins with a stem, and a
misspelled hit of the same weight if the Levenshtein automata (one edit or swap) of all terms
and stems, run together along the edges of their trie, accept it. Hits inside quotation marks or next to words of reporting are
counted apart, so that a quotation weighs as the labels say and not as abuse does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.llm.buffers import slices
from nightframes.llm.tables import staged, trimmed

# Labelled documents a model is fitted on at most: those of least hash of their id.
SAMPLE_ROWS = 20_000
# Terms a lexicon holds at most, by the number of toxic documents that have them.
MAX_TERMS = 2_000
STEMS = range(4, 10)
# A term is taken if it occurs in this share of toxic documents, if its log-odds of being in
# a toxic rather than a clean document reach this weight, and also do so with less for one
# standard error, which keeps chance finds of small samples out.
LEAST_SHARE = 0.01
LEAST_WEIGHT = 2.0
LEAST_SURE_WEIGHT = 1.5
# Misspellings are looked for of all words and stems of this length; shorter ones have too
# many neighbours.
FUZZY_LENGTH = 5
# A word near a term is one of its own if this many clean documents have it: one would let
# the documents learned from excuse their own words, which new documents cannot.
ORDINARY_DOCUMENTS = 2
# Words to each side of a hit that are its context.
CONTEXT = 4
THRESHOLD = 0.7
KEPT_WORDS = 400_000
KEPT_STEPS = 200_000
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUOTES = re.compile("[\"“”„«»‹›]")
# Words that announce a quotation; fixed values.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes cited reported word words term slur insult"
    " sagte schrieb nannte zitiert wort dit écrit appelé cité mot dijo escribió llamó citó palabra".split()
)
FEATURES = ("hits", "misspelled", "quoted", "quoted_misspelled", "density")
# Besides weights: a misspelled hit is the term's weight with a minus.
REPORTS = -math.inf


class Step(dict):
    """A state of the automata run together: where it leads by letter, filled in as words need it.

    ``at`` holds (node, kind): EXACT with no edit so far, EDITED with one, or the letter that
    is to come second of two swapped. ``stems`` are those met so far, ``terms`` all that are
    accepted if the word ends here, ``weight`` is the largest of theirs.
    """

    __slots__ = ("trie", "at", "stems", "terms", "weight")

    def __init__(self, trie: Trie, at: frozenset, stems: frozenset):
        super().__init__()
        self.trie, self.at, self.stems = trie, at, stems
        ends = {node for node, kind in at if kind in (EXACT, EDITED)}
        # the last letter may be missing
        ends.update(child for node, kind in at if kind == EXACT for child in trie.below[node].values())
        self.terms = stems.union(trie.words[node] for node in ends if trie.words[node])
        self.weight = max(map(trie.weights.__getitem__, self.terms), default=0.0)

    def __missing__(self, c: str) -> Step:
        below, at, read = self.trie.below, set(), set()  # nodes whose last letter is read just now
        for node, kind in self.at:
            child = below[node].get(c)
            if kind == EXACT:
                at.add((node, EDITED))  # c is one too many
                for letter, other in below[node].items():
                    after = below[other].get(c)
                    if after is not None:
                        at.add((after, EDITED))  # letter is missing
                        read.add(after)
                        if letter != c:
                            at.add((after, letter))  # swapped: letter comes after c
                    if letter != c:
                        at.add((other, EDITED))  # c for letter
                if child is not None:
                    at.add((child, EXACT))
                    read.add(child)
            elif kind == EDITED:
                if child is not None:
                    at.add((child, EDITED))
                    read.add(child)
            elif kind == c:
                at.add((node, EDITED))
                read.add(node)
        met = self.stems.union(self.trie.stems[node] for node in read if self.trie.stems[node])
        self[c] = step = self.trie.step(frozenset(at), met)
        return step


EXACT, EDITED = 0, 1


class Trie:
    """Terms (stems with a star) and their weights as numbered nodes, for words one edit away.

    A stem is met where its last letter is read: an edit of that letter would only make it a
    shorter stem, which the lexicon has or has refused.
    """

    def __init__(self, terms):
        self.weights = terms if isinstance(terms, dict) else dict.fromkeys(terms, 1.0)
        self.below: list[dict[str, int]] = [{}]
        self.words, self.stems = [""], [""]
        for term in self.weights:
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.below[node]:
                    self.below[node][c] = len(self.below)
                    self.below.append({})
                    self.words.append("")
                    self.stems.append("")
                node = self.below[node][c]
            (self.stems if term.endswith("*") else self.words)[node] = term
        self.restart()

    def restart(self) -> None:
        self.steps: dict = {}
        self.made = 0
        self.start = self.step(frozenset([(0, EXACT)]), frozenset())

    def step(self, at: frozenset, stems: frozenset) -> Step:
        self.made += 1
        if (at, stems) not in self.steps:
            self.steps[at, stems] = Step(self, at, stems)
        return self.steps[at, stems]

    def last(self, word: str) -> Step:
        """Where the word ends: the terms no more than one insertion, deletion, substitution or swap away."""
        if self.made > KEPT_STEPS:
            self.restart()
        step = self.start
        for c in word:
            step = step[c]
            if not step.at:
                break
        return step

    def near(self, word: str) -> bool:
        return bool(self.last(word).terms)


@dataclass
class Model:
    """Weights of words and of stems (with a star), those to find misspelled, words that are none, feature weights."""

    terms: dict[str, float]
    fuzzy: dict[str, float]
    ordinary: frozenset
    weights: tuple

    def exact(self):
        """Maps a word in small letters to the weight of the term it is or begins with, or 0."""
        terms = self.terms
        lengths = sorted({len(t) - 1 for t in terms if t.endswith("*")})
        return lambda word: max([terms.get(word, 0.0), *(terms.get(word[:k] + "*", 0.0) for k in lengths if k <= len(word))])

    def matcher(self) -> dict:
        """Maps a word as it stands in a text (bytes) to the weight of a hit, less than 0 if misspelled, to REPORTS or 0."""
        known, ordinary, trie = self.exact(), self.ordinary, Trie(self.fuzzy)

        def misspelled(word: str) -> float:
            return trie.last(word).weight if len(word) >= FUZZY_LENGTH - 1 and word not in ordinary else 0.0

        class Known(dict):
            def __missing__(self, raw: bytes) -> float:
                if len(self) > KEPT_WORDS:
                    self.clear()
                text = raw.decode(errors="replace").lower()
                parts = LETTERS.findall(text)
                kind = max(map(known, parts), default=0.0)
                if not kind:
                    # also with digits or signs for letters
                    whole = text.strip(".,;:!?()[]\"'“”«»")
                    if any(p in REPORTING for p in parts):
                        kind = REPORTS
                    else:
                        kind = -max(map(misspelled, {*parts, whole}))
                self[raw] = kind
                return kind

        return Known()


def features(text: bytes, known: dict) -> list[float]:
    """FEATURES of one text: logarithms of summed weights and of counts, weight per hundred words."""
    words = text.split()
    kinds = [known[w] for w in words]
    sums = [0.0, 0.0, 0.0, 0.0]
    if any(kinds):
        marked = QUOTES.search(text.decode(errors="replace"))
        marks = [bool(QUOTES.search(w.decode(errors="replace"))) for w in words] if marked else None
        for i, kind in enumerate(kinds):
            if kind and kind != REPORTS:
                lo, hi = max(0, i - CONTEXT), i + CONTEXT + 1
                quoted = REPORTS in kinds[lo:hi] or (marks is not None and any(marks[lo : i + 1]) and any(marks[i:hi]))
                sums[2 * quoted + (kind < 0)] += abs(kind)
    return [*(math.log1p(c) for c in sums), 10 * (sums[0] + sums[1]) / (len(words) + 20)]


def texts_of(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


class Terms(dict):
    """The terms of a word, itself and its stems with a star; only ``wanted`` ones if these are given."""

    def __init__(self, wanted: set[str] | None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple:
        if len(self) > KEPT_WORDS:
            self.clear()
        found = (word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k))
        self[word] = found if self.wanted is None else tuple(t for t in found if t in self.wanted)
        return self[word]

    def of(self, text: bytes) -> set[str]:
        words = set(LETTERS.findall(text.decode(errors="replace").lower()))
        return set(chain.from_iterable(map(self.__getitem__, words)))


def counted(wanted: set[str] | None):
    """Documents of each class per term, summed over a task."""

    def count(batches):
        met, terms_of = {0: Counter(), 1: Counter()}, Terms(wanted)
        for batch in batches:
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                if wanted is not None or toxic:
                    met[toxic].update(terms_of.of(text))
        terms = sorted(met[0].keys() | met[1].keys())
        for lo in range(0, len(terms), 10_000):
            some = terms[lo : lo + 10_000]
            yield pa.RecordBatch.from_pydict(
                {"term": some, "toxic": [met[1][t] for t in some], "clean": [met[0][t] for t in some]},
                schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
            )

    return count


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and class of at most SAMPLE_ROWS documents that may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # the documented sample
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most SAMPLE_ROWS rows of two numbers are broadcast
    return staged(rows.join(F.broadcast(known), "doc_id").select("text", "toxic"), "labelled")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def log_odds(r, toxic: int, clean: int, errors: float) -> float:
    """Of being in a toxic rather than a clean document, with so many standard errors added."""
    odds = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 1.5) / (clean + 3))
    return odds + errors * math.sqrt(1 / (r["toxic"] + 0.5) + 1 / (r["clean"] + 1.5))


def learn_terms(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    schema = "term string, toxic bigint, clean bigint"
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    least = max(2, math.ceil(LEAST_SHARE * toxic))
    frequent = sample.filter("toxic = 1").mapInArrow(counted(None), schema).groupBy("term").agg(*sums)
    # terms with enough toxic documents: at most documents times words of the bounded sample
    wanted = {r["term"] for r in frequent.filter(F.col("toxic") >= least).select("term").collect()}
    found = sample.mapInArrow(counted(wanted), schema).groupBy("term").agg(*sums).collect()

    def weight(r, errors: float = 0.0) -> float:
        return log_odds(r, toxic, clean, errors)

    def fits(r) -> bool:
        return weight(r) >= LEAST_WEIGHT and weight(r, -1.0) >= LEAST_SURE_WEIGHT

    good = sorted(((-weight(r) * r["toxic"], r["term"], r["toxic"]) for r in found if fits(r)))[:MAX_TERMS]
    return {term: -strength / n for strength, term, n in good}


def feature_rows(model: Model, columns: dict[str, pa.DataType]):
    def rows(batches):
        known = model.matcher()
        for batch in batches:
            for part in slices(batch):
                values = np.array([features(t, known) for t in texts_of(part)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), *(pa.array(v) for v in values.T)], [*columns, *FEATURES]
                )

    return rows


def ordinary_words(sample: DataFrame, fuzzy: dict[str, float]) -> frozenset:
    """Words of ORDINARY_DOCUMENTS clean documents that are one edit away from a term: they are words of their own."""

    def near(batches):
        trie, met = Trie(fuzzy), Counter()
        for batch in batches:
            for text in texts_of(batch):
                met.update({w for w in LETTERS.findall(text.decode(errors="replace").lower()) if len(w) >= FUZZY_LENGTH - 1})
        found = sorted(w for w in met if trie.near(w))
        yield pa.RecordBatch.from_pydict(
            {"word": found, "n": [met[w] for w in found]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())])
        )

    found = sample.filter("toxic = 0").mapInArrow(near, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    own = found.filter(F.col("n") >= ORDINARY_DOCUMENTS).collect()  # of the bounded sample
    return frozenset(r["word"] for r in own) - fuzzy.keys()


def unsure(sample: DataFrame, model: Model, toxic: int, clean: int) -> set[str]:
    """Terms whose misspellings are no sign: clean documents have so many that the log-odds of
    these, with two standard errors more, stay below what a term needs."""

    def count(batches):
        trie, met = Trie(model.fuzzy), {0: Counter(), 1: Counter()}
        exact = model.exact()
        for batch in batches:
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                words = set(LETTERS.findall(text.decode(errors="replace").lower()))
                near = (trie.last(w).terms for w in words if len(w) >= FUZZY_LENGTH - 1 and w not in model.ordinary and not exact(w))
                met[label].update(set().union(*near))
        terms = sorted(met[0].keys() | met[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"term": terms, "toxic": [met[1][t] for t in terms], "clean": [met[0][t] for t in terms]},
            schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
        )

    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    found = sample.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(*sums).collect()
    return {r["term"] for r in found if log_odds(r, toxic, clean, 2.0) < LEAST_WEIGHT}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms and weights. Without labelled rows of both classes every score is 0."""
    sample = labelled(docs, labels)
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, {}, frozenset(), (-50.0, *[0.0] * len(FEATURES)))
    terms = learn_terms(sample, counts[1], counts[0])
    fuzzy = {t: w for t, w in terms.items() if len(t.removesuffix("*")) >= FUZZY_LENGTH}
    model = Model(terms, fuzzy, ordinary_words(sample, fuzzy), ())
    no_sign = unsure(sample, model, counts[1], counts[0])
    model.fuzzy = {t: w for t, w in fuzzy.items() if t not in no_sign}
    rows = sample.mapInArrow(feature_rows(model, {"toxic": pa.int32()}), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    table = rows.toArrow()  # at most SAMPLE_ROWS rows of numbers
    x = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
    weights = logistic(x, table.column("toxic").to_numpy().astype(float))
    # labelled samples hold few misspellings or none: one weighs at least half of a hit
    weights[2], weights[4] = max(weights[2], weights[1] / 2), max(weights[4], weights[3] / 2)
    model.weights = tuple(weights)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method, weights of evidence not below zero.

    Equal rows are put together first, so that the result does not hang on their order.
    """
    x = np.column_stack([np.ones(len(x)), x])
    rows, number = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y, number = rows[:, :-1], rows[:, -1], number.astype(float)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (number * (p - y)) + penalty * w
        curve = (x * (number * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, model: Model, columns: list[str], names=("score", "predicted")) -> DataFrame:
    """The named columns, then score and predicted as ``names``, of every row of ``docs`` (which has a text)."""
    weights = np.array(model.weights)

    def rows(batches):
        known = model.matcher()
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t, known) for t in texts_of(part)]).reshape(-1, len(FEATURES))
                z = weights[0] + x @ weights[1:]
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                predicted = (score >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(score), pa.array(predicted)],
                    [*columns, *names],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.mapInArrow(trimmed(rows), f"{kinds}, {names[0]} double, {names[1]} int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on), for every row.

    Only the text decides. Learned from rows whose crc32 of the doc_id as text leaves another
    remainder than 1 by 3 (held_out tells). Null and empty texts get the score of a text
    without hits. Repeated rows get equal scores; a row without doc_id is not held out and not
    learned from; of several labels of a document the highest counts. Other columns are ignored.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = scores(rows, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    kept = scores(docs, fit(docs, labels), docs.columns, ("__nf_score", "__nf_predicted"))
    return kept.filter("__nf_predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
