"""Toxicity by Levenshtein automata over a lexicon trie, judged in a context window.

The lexicon is learned: terms and stems (first letters shared by several words) that are far more frequent in
texts labelled toxic than in others, counted over a bounded sample of labelled rows. A word is read by the Levenshtein
automata of all terms at once, run over the trie of the lexicon; their product's states are built when first
met and kept, so a word costs one step per letter and most words end after a few. A long term allows more
edits than a short one. A hit is then judged by the words around it: inside quotation marks or
next to words of reporting it counts for less, next to other hits for more. A small logistic model over the
sums of these scores, fitted on the same sample, gives the text's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import label_counts, sigmoid, training_sample

#: Letters of the stems that are tried.
STEMS = (4, 5, 6, 7, 8)
#: Marks that open or close a quotation, and words that report one.
QUOTES = "\"'“”„‟«»‹›‘’‚`「」"
REPORTING = frozenset("said says say quoted quote quotes called calls wrote writes reported reports word term dijo dice llamó citó écrit dit cité appelé sagte sagt schrieb zitierte nannte".split())
#: Distinct words a worker remembers; the memory is emptied when full, results never change.
REMEMBERED_WORDS = 300_000

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(word: str) -> str:
    """A word without the marks around it."""
    return word if word.isalnum() else _EDGES.sub("", word)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all lexicon terms, intersected with the lexicon's trie, built as words need them."""

    def __init__(self, terms: dict[str, float]):
        """``terms``: weight by term; a term that ends in ``*`` is a stem and matches every word that begins so."""
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.limit = [0]
        for term in sorted(terms):
            letters, node = term.removesuffix("*"), 0
            edits = 0 if term.endswith("*") else allowed_edits(letters)
            self.limit[0] = max(self.limit[0], edits)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(None)
                    self.stem.append(None)
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], edits)
            (self.stem if term.endswith("*") else self.whole)[node] = term
        self.alphabet = {c for node in self.children for c in node}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[tuple[tuple[int, int], ...], str | None]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem: str | None) -> int:
        """The number of a state: the least edits to reach each trie node, letters left out included."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.limit[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in nodes.items():
            if e == 0 and stem is None:
                stem = self.stem[node]
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.ids:
            if not nodes and stem is None:
                self.ids[key] = -1
                return -1
            self.ids[key] = len(self.states)
            self.states.append(key)
            ends = [(e, t) for node, e in nodes.items() if (t := self.whole[node]) and e <= allowed_edits(t)]
            best = min(ends, default=None)
            self.accepts.append((best[1], best[0]) if best and (stem is None or best[0] == 0) else (stem, 0) if stem else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        old, stem = self.states[state]

        def reach(node: int, e: int) -> None:
            if e <= self.limit[node] and nodes.get(node, 99) > e:
                nodes[node] = e

        for node, e in old:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        return self._state(nodes, stem)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest lexicon term within its allowed edits, and the number of edits."""
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for c in word:
            key = (state, c if c in alphabet else "")
            state = moves.get(key, -2)
            if state == -2:
                state = moves[key] = self._move(*key)
            if state < 0:
                return None
        return self.accepts[state]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    window: int = 8

    def __post_init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._automaton: LexiconAutomaton | None = None
        self._cold: set[str] = set()
        self._hot: dict[str, tuple[str, int]] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "window": self.window}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def hits(self, words: list[str]) -> list[dict]:
        """The lexicon hits among a whole text's words, by position, with their context."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        distinct = set(words)
        for w in distinct - self._cold:
            if w not in self._hot:
                found = self._automaton.match(bare(w))
                if found:
                    self._hot[w] = found
                else:
                    self._cold.add(w)
        if len(self._cold) + len(self._hot) > REMEMBERED_WORDS:
            self._cold.clear()
            hot, self._hot = self._hot, {}
        else:
            hot = self._hot
        if distinct.isdisjoint(hot):
            return []
        at = [i for i, w in enumerate(words) if w in hot]
        return [self._judged(words, i, at, k, *hot[words[i]]) for k, i in enumerate(at)]

    def _judged(self, words: list[str], i: int, at: list[int], k: int, term: str, edits: int) -> dict:
        low, high = max(0, i - self.window), i + self.window + 1
        opened = sum(w[0] in QUOTES for w in words[low : i + 1]) - sum(w[-1] in QUOTES for w in words[low:i])
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[i:high] if w)
        reported = any(bare(w) in REPORTING for w in words[max(0, i - 3) : i])
        near = sum(j != i for j in at[max(0, k - 1) : k + 2] if low <= j < high)
        return {"term": term, "position": i, "edits": edits, "quoted": (opened > 0 and closed) or reported, "near": near}

    def features(self, found: list[dict], words: int) -> np.ndarray:
        """Strongest, summed and, for the text's length, dense plain hits, misspelled hits, quoted hits, and 1."""
        plain, misspelled, quoted = [], [], []
        for h in found:
            strength = min(1.0, self.terms[h["term"]] / 4) * (1 + 0.25 * h["near"])
            (quoted if h["quoted"] else misspelled if h["edits"] else plain).append(strength / (1 + h["edits"]))
        dense = min(1.0, sum(plain) * 100 / max(100, words))
        return np.array([max(plain, default=0.0), np.log1p(sum(plain)), dense, np.log1p(sum(misspelled)), np.log1p(sum(quoted)), 1.0])

    def score(self, found: list[dict], words: int) -> float:
        return float(sigmoid(self.features(found, words) @ self.weights))


#: Where the logistic model starts, and what it stays near where the sample says nothing.
PRIOR = np.array([2.0, 2.0, 0.0, 2.0, 0.5, -2.5])


def _counting(among: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that hold a term or stem, summed over many rows of a task; ``among``: of these terms alone."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                terms = terms_in(text)
                counts.update(terms if among is None else terms & among)
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return counted


def terms_in(text: str | None) -> set[str]:
    """The bare words of a text and their stems."""
    words = {bare(w) for w in set(words_of(text))}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _akin(a: str, b: str) -> bool:
    """True if one of two terms is a stem of the other."""
    x, y = a.removesuffix("*"), b.removesuffix("*")
    return (a != x and y.startswith(x)) or (b != y and x.startswith(y))


def learn_lexicon(usable: DataFrame, min_share: float, min_rows: int, min_ratio: float) -> tuple[dict[str, float], int, int]:
    """Weights (log ratios of document shares) by term; clean and toxic rows of the training rows.

    Candidates stand in at least ``min_share`` of the toxic rows, so there are at most as many as an average toxic
    row has terms, times 1 / ``min_share``, whatever the input's size. Of these a term is taken only as long as it
    explains toxic rows that no term taken before explains, the one that explains most first: so the harmless
    words of a toxic text with many copies stay out.
    """
    totals = label_counts(usable, "label")
    clean, toxic = totals.get(0, 0), sum(n for y, n in totals.items() if y)
    if not toxic:
        return {}, clean, toxic
    least = max(min_rows, min_share * toxic)

    def rows_with(label: str, among: frozenset[str] | None) -> DataFrame:
        return usable.filter(label).select("text").mapInArrow(_counting(among), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    in_toxic = {r["term"]: r["n"] for r in rows_with("label != 0", None).filter(F.col("n") >= least).collect()}
    in_clean = {r["term"]: r["n"] for r in rows_with("label = 0", frozenset(in_toxic)).collect()}
    shares = {t: ((n + 0.5) / (toxic + 1)) / ((in_clean.get(t, 0) + 0.5) / (clean + 1)) for t, n in in_toxic.items()}
    candidates = {t: float(np.log(s)) for t, s in shares.items() if s >= min_ratio}

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms_in(t) & candidates.keys()) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["terms"])

    sample = usable.filter("label != 0").select("text").mapInArrow(found_in, "terms array<string>")
    rows_of = [set(t) for t in sample.toArrow()["terms"].to_pylist() if t]
    kept: dict[str, float] = {}
    for share in (min_share, 6 * min_share):  # a second round finds terms that seldom stand alone, if they are frequent
        unexplained = [terms - kept.keys() for terms in rows_of]
        enough = max(1.0, max(min_rows, share * toxic) * len(rows_of) / toxic)
        told = list(kept)
        gain = Counter(t for terms in unexplained for t in terms if not any(_akin(t, k) for k in told))
        while gain:
            best = max(gain, key=lambda t: (gain[t] * min(1.0, candidates[t] / 4), not t.endswith("*"), len(t), candidates[t], t))
            if gain[best] < enough:
                break
            kept[best] = candidates[best]
            for terms in unexplained:
                if best in terms:
                    gain.subtract(t for t in terms if t in gain)
            unexplained = [terms for terms in unexplained if best not in terms]
            gain = +gain
    return kept, clean, toxic


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = 12000, min_share: float = 0.005, min_rows: int = 3, min_ratio: float = 8.0, ridge: float = 0.001) -> ToxicityModel:
    """Learn the lexicon and the weights of its hits from a sample of about ``rows`` labelled rows, even over the classes.

    Rows with a null label teach nothing; a null text is an empty one. Without toxic rows the lexicon is empty, and
    every score is the starting model's score of a text without hits.
    """
    usable, counts = training_sample(documents, labels, text, label, key, rows)
    terms, clean, toxic = learn_lexicon(usable, min_share, min_rows, min_ratio)
    model = ToxicityModel(terms)
    if not clean or not toxic:
        return model

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(model.hits(w), len(w)).tolist() for w in map(words_of, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = usable.mapInArrow(featured, "label int, x array<double>").toArrow()
    rows_ = sorted(zip(got["label"].to_pylist(), got["x"].to_pylist(), strict=True))
    if rows_:
        y, x = np.array([bool(r[0]) for r in rows_]), np.array([r[1] for r in rows_])
        # the sample is even over the classes; the score is meant for texts as frequent as in all rows
        all_clean, all_toxic = counts.get(0, 0), sum(n for c, n in counts.items() if c)
        weight = np.where(y, all_toxic / max(1, y.sum()), all_clean / max(1, (~y).sum())) / (all_clean + all_toxic)
        w = PRIOR.copy()
        for _ in range(50):  # Newton steps on the weighted logistic loss, drawn to the start
            p = sigmoid(x @ w)
            gradient = x.T @ (weight * (p - y)) + ridge * (w - PRIOR)
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        model.weights = w
    return model


HITS = "array<struct<term:string,position:int,edits:int,quoted:boolean,near:int>>"


def judge(text: Column | str, model: ToxicityModel) -> Column:
    """struct<score double, hits array<...>>: the score, and each hit with its word position and context.

    Null and empty texts have no hits and the score of a text without hits. Equal texts get equal results.
    """

    @F.arrow_udf(f"struct<score:double,hits:{HITS}>")
    def toxicity(column: pa.Array) -> pa.Array:
        found, scores = [], []
        for words in map(words_of, column.to_pylist()):
            found.append(model.hits(words))
            scores.append(model.score(found[-1], len(words)))
        kind = pa.list_(pa.struct([("term", pa.string()), ("position", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("near", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], names=["score", "hits"])

    return toxicity(F.col(text) if isinstance(text, str) else text)
