"""Toxicity of texts from a learned lexicon, misspellings included, and its contexts.

Learning: on a bounded sample of labelled rows, words and word beginnings that occur
in toxic texts significantly more often than chance allows become the lexicon (whole
words, or stems where most of a beginning's weight lies in its continuations).

Matching: the lexicon is a trie. A Levenshtein automaton is run over it in step: a
state is a set of (trie node, edits so far), and the automaton of all words within
the allowed distance of all terms at once is made state by state as texts need it.
Short terms must match exactly, longer ones allow one or two edits; stems match
beginnings of words.

Context: each hit looks at a window of words around it. Quotation marks around it and
words of reporting or definition make it a quotation, otherwise it counts as abuse.
Exact and misspelled hits of both kinds, the log odds of the terms and the density of
hits are weighted by logistic regression, which gives a score from 0 to 1.

Null and empty texts have no hits and get the score of a text without hits. Repeated
rows get equal scores. Labels that are null are not learned from; of several labels
for one id the highest counts. Without any positive or any negative label the lexicon
is empty and the score is the share of positives (0.0 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import forget, in_worker, keep
from basketry.llm.jaccard import shingles

STRIP = ".,;:!?()[]{}<>*#$%&=+|/\\_-~`^\"'“”„‘’«»…"
QUOTES = "\"“”„«»"
#: Words that show a term is reported or explained rather than used.
REPORTING = frozenset(
    "said says wrote writes called quote quoted quotes word words term means meaning defined "
    "definition slur insult insults example translated".split()
)
WINDOW = 5
#: Lengths of the word beginnings that are counted.
STEMS = range(3, 9)
#: Minimum hashes by which labelled rows that may be much alike are found, the least
#: hashes kept to compare them, and the Jaccard similarity from which they are.
SIGNS = 4
SKETCH = 128
ALIKE = 0.75
CACHE_SIZE = 200_000
STATES = 20_000


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All words within the allowed distance of a lexicon's terms, made as needed.

    ``terms`` are words; those that end in ``*`` are stems. States are sets of
    (trie node, edits), numbered; 0 is the dead state.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits allowed by any term below a node
        self.whole: dict[int, tuple[int, int]] = {}  # node: (term, edits allowed)
        self.stem: dict[int, tuple[int, int]] = {}
        for number, term in enumerate(terms):
            bare, node = term.removesuffix("*"), 0
            edits = allowed_edits(bare)
            self.most[0] = max(self.most[0], edits)
            for char in bare:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][char]
                self.most[node] = max(self.most[node], edits)
            (self.stem if term.endswith("*") else self.whole)[node] = (number, edits)
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[list, list]] = [([], [])]  # hits of stems and whole words by state
        self.begin = self._add({(0, 0)})

    def _add(self, state: set[tuple[int, int]]) -> int:
        """Number of a state, with what it reaches by leaving out characters of terms."""
        todo = list(state)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.most[child] and (child, edits + 1) not in state:
                    state.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in state:
            least[node] = min(edits, least.get(node, edits))
        frozen = frozenset(least.items())
        if frozen not in self.number:
            self.number[frozen] = len(self.states)
            self.states.append(frozen)
            self.next.append({})
            self.ends.append((self._hits(frozen, self.stem), self._hits(frozen, self.whole)))
        return self.number[frozen]

    def _step(self, state: int, char: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            if edits < self.most[node]:
                after.add((node, edits + 1))  # a character too many
            for own, child in self.children[node].items():
                used = edits + (own != char)
                if used <= self.most[child]:
                    after.add((child, used))
        return self._add(after)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, or None."""
        if len(self.states) > STATES:
            self.number, self.states, self.next = {frozenset(): 0}, [frozenset()], [{}]
            self.ends = [([], [])]
            self.begin = self._add({(0, 0)})
        state, found, ends = self.begin, [], self.ends
        for char in word:
            after = self.next[state].get(char)
            if after is None:
                after = self.next[state][char] = self._step(state, char)
            state = after
            if not state:
                break
            found += ends[state][0]
        else:
            found += ends[state][1]
        return min(found, key=lambda f: (f[1], f[0]), default=None)

    @staticmethod
    def _hits(state: frozenset, ends: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
        """(term, edits) of the terms that end in a state."""
        hits = [(ends[node], edits) for node, edits in state if node in ends]
        return [(term, edits) for (term, most), edits in hits if edits <= most]


class Scorer:
    FEATURES = 8

    def __init__(self, terms: tuple[str, ...], worth: tuple[float, ...]):
        self.automaton, self.worth = Automaton(terms), worth
        self.cache: dict[str, tuple[int, int] | None] = {}

    def hits(self, tokens: list[str]) -> list[tuple[int, tuple[int, int]]]:
        """(place, (term, edits)) of the tokens that match."""
        known = self.cache
        if len(known) >= CACHE_SIZE:
            known.clear()
        for token in set(tokens):
            if token not in known:
                known[token] = self.automaton.match(token.lower().strip(STRIP))
        return [(i, hit) for i, hit in enumerate(map(known.__getitem__, tokens)) if hit]

    def features(self, text: str | None) -> list[float]:
        tokens = text.split() if text else []
        hits = self.hits(tokens)
        counts, terms = [0, 0, 0, 0], set()
        for i, (term, edits) in hits:
            counts[2 * bool(edits) + self.quoted(tokens, i)] += 1
            if not edits and not self.quoted(tokens, i):
                terms.add(term)
        logs = [math.log1p(c) for c in counts]
        worth = [self.worth[t] for t in terms]
        density = sum(counts[::2]) / (len(tokens) or 1)
        return [1.0, *logs, max(worth, default=0.0), math.log1p(sum(worth)), math.sqrt(density)]

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        start, end = max(0, at - WINDOW), at + WINDOW + 1
        before, after = tokens[start : at + 1], tokens[at:end]
        opened = any(t[0] in QUOTES for t in before)
        closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after if t)
        reported = any(t.lower().strip(STRIP) in REPORTING for t in tokens[start:end])
        return (opened and closed) or reported


@dataclass(frozen=True)
class Model:
    """``worth``: each term's log odds ratio, smoothed; ``weights``: of the features."""

    terms: tuple[str, ...]
    worth: tuple[float, ...]
    weights: tuple[float, ...]


def _scorer(terms: tuple[str, ...], worth: tuple[float, ...]) -> Scorer:
    return in_worker((terms, worth), lambda: Scorer(terms, worth))


def _prints(text: Column) -> Column:
    """struct<content, signs, sketch> of the three-word shingles of a text.

    ``content`` is a hash of all of them, ``signs`` are minimum hashes, of which texts much
    alike share most, ``sketch`` holds the :data:`SKETCH` least, by their upper 32 bits.
    """

    @F.arrow_udf("struct<content: bigint, signs: array<bigint>, sketch: binary>")
    def prints(texts: pa.Array) -> pa.Array:
        contents, signs, sketches = [], [], []
        for text in texts:
            values = shingles(text.as_py(), 3)
            mixed = [(values * np.uint64(2 * k + 0x9E3779B97F4A7C15)).view(np.int64) for k in range(SIGNS)]
            contents.append(xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63)
            signs.append([int(m.min()) if len(m) else 0 for m in mixed])
            sketches.append((values[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(contents, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["content", "signs", "sketch"],
        )

    return prints(text)


def alike(one: bytes, other: bytes) -> float:
    """Jaccard similarity of two sets by their sketches; exact for at most ``SKETCH`` values."""
    a, b = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
    both = np.union1d(a, b)
    if max(len(a), len(b)) == SKETCH:
        both = both[:SKETCH]
    shared = np.intersect1d(a, b)
    return np.isin(both, shared).sum() / len(both) if len(both) else 1.0


def _alike(one: Column, other: Column) -> Column:
    @F.arrow_udf("double")
    def similarity(ones: pa.Array, others: pa.Array) -> pa.Array:
        return pa.array([float(alike(a.as_py(), b.as_py())) for a, b in zip(ones, others)], pa.float64())

    return similarity(one, other)


def distinct_rows(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, content, toxic): rows of (doc, text) with a label of (doc, toxic), without those
    much like a row that stays.

    A row goes only if a row of the same label with a smaller id stays whose shingles are
    the same, or have a Jaccard similarity of at least ``ALIKE``. Compared are rows that
    share a minimum hash, each with the first of them only.
    """
    # Before the join, so that no texts are shuffled.
    rows = texts.select("doc", _prints(F.col("text")).alias("p")).select("doc", "p.*").join(known, "doc")
    rows = rows.groupBy("toxic", "content").agg(
        F.min("doc").alias("doc"), F.any_value("signs").alias("signs"), F.any_value("sketch").alias("sketch")
    )
    rows = keep(rows, "labelled")
    signed = rows.select("toxic", "content", "doc", F.posexplode("signs").alias("place", "sign"))
    group = ["toxic", "place", "sign"]
    first = signed.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.struct("doc", "content")).alias("first"))
    first = keep(first.where("n > 1").select(*group, F.col("first.content").alias("other")), "labelled-first")
    pairs = signed.join(first, group).where("content <> other").select("toxic", "content", "other").distinct()
    others = rows.select("toxic", F.col("content").alias("other"), F.col("sketch").alias("other_sketch"))
    pairs = pairs.join(rows.select("toxic", "content", "sketch"), ["toxic", "content"])
    pairs = pairs.join(others, ["toxic", "other"])
    pairs = pairs.where(_alike(F.col("sketch"), F.col("other_sketch")) >= ALIKE)
    pairs = keep(pairs.select("toxic", "content", "other"), "labelled-alike")
    # Only against rows that stay: those that are like no earlier row.
    later = pairs.select("toxic", F.col("content").alias("other"))
    gone = pairs.join(later, ["toxic", "other"], "left_anti").select("toxic", "content").distinct()
    stay = keep(rows.join(gone, ["toxic", "content"], "left_anti").select("doc", "content", "toxic"), "labelled-distinct")
    for table in (rows, first, pairs):
        forget(table)
    return stay


def _words(text: str | None) -> set[str]:
    """Distinct words of letters, lower case."""
    return {w for w in (t.strip(STRIP) for t in set((text or "").lower().split())) if w.isalpha()}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a batch each term occurs; ``$`` ends whole words."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = _words(text.as_py())
            terms = {w[:n] for w in words for n in STEMS if n <= len(w)}
            counts[bool(toxic)].update(terms)
            counts[bool(toxic)].update(w + "$" for w in words if len(w) >= 3)
        terms = list(counts[1] | counts[0])
        for start in range(0, len(terms), 10_000):
            part = terms[start : start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array([counts[k][t] for t in part], pa.int64()) for k in (1, 0))],
                names=["term", "toxic", "clean"],
            )


def choose_terms(evidence: dict[str, float]) -> tuple[str, ...]:
    """The lexicon, from significant terms and their evidence: the best first, and none
    that begins another or goes on from it; stems are marked with ``*``.

    Of a word and its beginnings with equal evidence the whole word is taken.
    """
    chosen: set[str] = set()
    begun: set[str] = set()  # beginnings of the chosen
    for term in sorted(evidence, key=lambda t: (-round(evidence[t], 6), -len(t), t)):
        own = {term[:n] for n in range(1, len(term) + 1)}
        if term not in begun and own.isdisjoint(chosen):
            chosen.add(term)
            begun |= own
    return tuple(sorted(t[:-1] if t.endswith("$") else t + "*" for t in chosen))


def regress(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is the constant."""
    weights = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge * max(1.0, len(rows) / 100))
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (labels - p) - penalty * weights
        curvature = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty)
        change = np.linalg.solve(curvature, gradient)
        weights += change
        if np.abs(change).max() < 1e-8:
            break
    return weights


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str,
    text_column: str,
    label_column: str,
    max_positive: int = 5_000,
    max_negative: int = 15_000,
) -> Model:
    """Learn from at most ``max_positive`` and ``max_negative`` labelled rows.

    The rows are chosen by hash of the id, so the same ones in every run. Rows of one label
    that are much alike count once (see :func:`distinct_rows`), before the choice: words
    that copies share prove nothing. ``labels`` must hold only what may be learned from.
    """
    known = labels.select(F.col(id_column).cast("long").alias("doc"), F.col(label_column).cast("int").alias("toxic"))
    known = known.where("doc is not null and toxic is not null").groupBy("doc").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc", (F.col("toxic") > 0).alias("toxic"))
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    single = distinct_rows(texts, known)
    order = [F.xxhash64("doc"), "doc", "content"]
    sample = single.where("toxic").orderBy(*order).limit(max_positive)
    sample = sample.unionAll(single.where("not toxic").orderBy(*order).limit(max_negative))
    # Broadcast: at most max_positive + max_negative rows of two numbers and a label.
    chosen = texts.join(F.broadcast(sample), "doc")
    # A text is hashed once its row is chosen: what names columns of both sides stays above the join.
    content = _prints(F.when(F.col("toxic").isNotNull(), F.col("text")))["content"]
    chosen = chosen.where(content == F.col("content"))
    # Rows that repeat id and text count as one.
    chosen = chosen.groupBy("doc", "content", "toxic").agg(F.any_value("text").alias("text"))
    texts = keep(chosen.select("text", "toxic"), "distinct-labelled")
    forget(single)
    total = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    positive, negative = total.get(True, 0), total.get(False, 0)
    if not positive or not negative:
        share = (positive + 0.5) / (positive + negative + 1) if positive or negative else 0.0
        bias = math.log(share / (1 - share)) if share else -math.inf
        return Model((), (), (bias, *[0.0] * (Scorer.FEATURES - 1)))

    base = positive / (positive + negative)
    counted = (
        texts.mapInArrow(_count_terms, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 4")
    )
    counted = keep(counted, "terms")
    # Evidence (log likelihood ratio) beyond what the best of all terms has by chance.
    enough = math.log(max(1, counted.count())) + 2
    share = F.expr("toxic / (toxic + clean)")
    evidence = F.col("toxic") * F.ln(share / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.ln((1 - share) / (1 - base))
    ).otherwise(0.0)
    kept = (
        counted.where((share >= 0.33) & (evidence >= enough))
        .select("term", "toxic", "clean", evidence.alias("evidence"))
        .collect()  # of words in at most max_positive texts
    )
    terms = choose_terms({r["term"]: r["evidence"] for r in kept})
    odds = {
        r["term"]: math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5)) - math.log(base / (1 - base)) for r in kept
    }
    worth = tuple(odds[t[:-1] if t.endswith("*") else t + "$"] for t in terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(terms, worth)
        for batch in batches:
            rows = [scorer.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["features", "toxic"]
            )

    rows = texts.mapInArrow(measure, "features array<double>, toxic boolean").toArrow()
    forget(counted)
    forget(texts)
    features = np.array(rows["features"].to_pylist(), float)
    weights = regress(features, rows["toxic"].to_numpy(zero_copy_only=False).astype(float))
    return Model(terms, worth, tuple(weights.tolist()))


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scorer, weights = _scorer(model.terms, model.worth), np.array(model.weights)
        if not len(texts):
            return pa.array([], pa.float64())
        rows = np.array([scorer.features(t.as_py()) for t in texts])
        with np.errstate(over="ignore", invalid="ignore"):
            sums = np.where(np.isinf(weights[0]), weights[0], rows @ np.nan_to_num(weights))
            return pa.array(1 / (1 + np.exp(-sums)))

    return scored(text)
