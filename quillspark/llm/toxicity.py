"""Toxicity scores from a learned lexicon, matched by Levenshtein automata over its trie.

Learning counts, over a bounded sample of labelled rows, in how many toxic and
other documents each word and each beginning of a word occurs; those that point
to toxic documents form a lexicon of words and stems. The lexicon's trie and the
automaton of one edit are intersected, lazily made deterministic: a word is read
once, whatever the size of the lexicon. Entries under ``FUZZY_FROM`` letters
have to match exactly. The rest of the sample, which the lexicon has not seen, says how much an exact
match, a misspelt one, and one that is only quoted (quotation marks or a verb of saying
within ``WINDOW`` words) are worth, and calibrates the sum of the evidence by logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import Stage, bounded_batches

#: About so many labelled rows are learned from, drawn in the order of a hash.
TRAIN_ROWS = 20_000
#: Entries of a lexicon at most, and in how many toxic documents of the sample each must be.
ENTRIES, SUPPORT = 4_000, 4
STEMS = range(4, 9)
FUZZY_FROM = 5
WINDOW = 5
THRESHOLD = 0.3
#: Words and automaton states that a worker keeps.
KEPT = 300_000

# Marks stripped from both ends of a word, quotation marks, verbs of saying.
_MARKS = ".,!?;:\"'()[]{}<>«»“”„‚‘’*_-–—…|#%&$/\\+=~`"
_OPEN, _CLOSE = "\"'«“„‘", "\"'»”“’"
_SAYING = frozenset("said says called quote quoted quotes word term wrote sagte nannte zitat dijo llamó cita dit appelé citation".split())

EXACT, FUZZY, QUOTED = 0, 1, 2


class Matcher:
    """Which entries are within one edit of a word. ``words`` match whole words, ``stems`` beginnings of words."""

    def __init__(self, words: list[str], stems: list[str]):
        self.entries = [*words, *stems]
        n_words = len(words)
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for k, entry in enumerate(self.entries):
            node = 0
            for c in entry:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.word_at if k < n_words else self.stem_at)[node] = k
        self.known: dict[str, tuple] = {}
        self._reset()

    def __getstate__(self):
        return self.entries, self.children, self.word_at, self.stem_at

    def __setstate__(self, state):
        self.entries, self.children, self.word_at, self.stem_at = state
        self.known = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.outputs: list[tuple] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        """items: (trie node, edits), or (-1 - entry, edits) once a stem has been read."""
        full = set(items)
        for node, edits in items:
            if node >= 0 and edits == 0:
                full.update((child, 1) for child in self.children[node].values())
        for node, edits in list(full):
            if node >= 0 and node in self.stem_at:
                entry = self.stem_at[node]
                if edits == 0 or len(self.entries[entry]) >= FUZZY_FROM:
                    full.add((-1 - entry, edits))
        key = frozenset(full)
        if key not in self.ids:
            best: dict[int, int] = {}
            for node, edits in key:
                entry = -1 - node if node < 0 else self.word_at.get(node)
                if entry is not None and (edits == 0 or len(self.entries[entry]) >= FUZZY_FROM):
                    best[entry] = min(edits, best.get(entry, 1))
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.outputs.append(tuple(sorted(best.items())))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, edits in self.sets[state]:
            if node < 0:
                to.add((node, edits))
                continue
            if c in self.children[node]:
                to.add((self.children[node][c], edits))
            if edits == 0:
                to.add((node, 1))
                to.update((child, 1) for child in self.children[node].values())
        to = self.moves[state][c] = self._state(to)
        return to

    def match(self, word: str) -> tuple:
        """Sorted (entry, edits)."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > KEPT:
            self.known = {}
        if len(self.sets) > KEPT:
            self._reset()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
        self.known[word] = found = self.outputs[state]
        return found

    def hits(self, text: str) -> dict[int, int]:
        """Best kind of match of each entry in a text; an entry that only occurs quoted is QUOTED."""
        chunks = text.lower().split()
        found = {}
        for chunk in set(chunks):
            m = self.match(chunk.strip(_MARKS))
            if m:
                found[chunk] = m
        out: dict[int, int] = {}
        if found:
            for at, chunk in enumerate(chunks):
                if chunk in found:
                    quoted = _is_quoted(chunks, at)
                    for entry, edits in found[chunk]:
                        kind = QUOTED if quoted else FUZZY if edits else EXACT
                        out[entry] = min(kind, out.get(entry, QUOTED))
        return out


def _is_quoted(chunks: list[str], at: int) -> bool:
    before, after = chunks[max(0, at - WINDOW) : at], chunks[at + 1 : at + 1 + WINDOW]
    opened = chunks[at][0] in _OPEN or any(c[0] in _OPEN and c[-1] not in _CLOSE for c in before)
    closed = chunks[at].rstrip(".,!?;:")[-1:] in _CLOSE and len(chunks[at]) > 1 or any(c.rstrip(".,!?;:")[-1:] in _CLOSE and c[0] not in _OPEN for c in after if c.rstrip(".,!?;:"))
    return opened and closed and (chunks[at][0] in _OPEN or not _SAYING.isdisjoint(c.strip(_MARKS) for c in before))


def _terms(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and beginnings of words followed by ``*``, with the toxic and other documents they are in."""
    for batch in _text.batches(source):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {c.strip(_MARKS) for c in set((text or "").lower().split())}
            words.discard("")
            terms = {w for w in words if len(w) >= 3}
            terms.update(w[:n] + "*" for w in words for n in STEMS if len(w) >= n)
            counts[toxic].update(terms)
        names = list(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["term", "bad", "good"])


class Model:
    """``weights[entry][kind]``: probability of toxicity given that match; ``slopes``: of the logistic regression on ``evidence``."""

    def __init__(self, matcher: Matcher, weights: list[tuple[float, float, float]], slopes: list[float]):
        self.matcher, self.weights, self.slopes = matcher, weights, slopes

    def evidence(self, hits: list[tuple[int, int]]) -> list[float]:
        """1, the sum of the matches' -log(1 - weight), the same up to 3, and the log of how many weigh over a half."""
        found = [self.weights[entry][kind] for entry, kind in hits]
        total = -sum(math.log(1.0 - min(0.999, w)) for w in found)
        return [1.0, total, min(3.0, total), math.log1p(sum(w > 0.5 for w in found))]

    def score(self, text: str | None) -> tuple[float, int]:
        """(score, matched entries)."""
        hits = list(self.matcher.hits(text or "").items())
        x = sum(a * b for a, b in zip(self.slopes, self.evidence(hits), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x)))), len(hits)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps of a logistic regression; the first column is the intercept."""
    slopes = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ slopes, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * slopes)
        slopes += np.clip(step, -3, 3)
    return slopes.tolist()


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """labelled: ``text``, ``toxic`` (0 or 1; rows without are left out). Without rows every score is next to 0."""
    labelled = labelled.select(F.col("text").cast("string").alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("toxic is not null")
    total = labelled.count()
    if not total:
        return Model(Matcher([], []), [], [-50.0, 0.0, 0.0, 0.0])
    # a hash of the text alone, so that the draw takes place below whatever join labelled is made by; a text that many rows repeat
    # is drawn once, so the bound holds whatever is repeated
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    sample = labelled.where(drawn < F.lit(min(1.0, rows / total) * 1_000_003)).distinct().withColumn("rest", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(3)) == 0)
    sample = Stage(labelled.sparkSession, "toxicity").save(sample, "sample")
    sample, rest = sample.where("not rest").drop("rest"), sample.where("rest").drop("rest")
    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sides.get(1, 0) + 1.0, sides.get(0, 0) + 1.0
    odds = (F.col("bad") + 0.1) / bad / ((F.col("good") + 0.1) / good)
    terms = sample.mapInArrow(_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    terms = terms.where((F.col("bad") >= SUPPORT) & (odds >= 30)).withColumn("gain", F.col("bad") * F.log(odds))
    terms = [r["term"] for r in terms.orderBy(F.desc("gain"), F.length("term"), "term").limit(ENTRIES).collect()]
    stems = {t[:-1] for t in terms if t.endswith("*")}
    # the shortest stem stands for what begins with it; a word that is a stem's only continuation stays a word
    words = sorted({t for t in terms if not t.endswith("*")})
    alone = {s for s in stems if sum(w.startswith(s) for w in words) <= 1 and any(w.startswith(s) for w in words)}
    stems -= alone
    stems = sorted(s for s in stems if not any(s[:n] in stems for n in range(1, len(s))))
    words = [w for w in words if not any(w[:n] in stems for n in range(1, len(w) + 1))]
    matcher = Matcher(words, stems)

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hits = [sorted(matcher.hits(t or "").items()) for t in batch.column(0).to_pylist()]
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([[e for e, _ in h] for h in hits], kinds), pa.array([[k for _, k in h] for h in hits], kinds)], names=["toxic", "entries", "kinds"])

    # bounded by the sample; most documents have no match
    seen = [(r["toxic"], list(zip(r["entries"], r["kinds"], strict=True))) for r in rest.mapInArrow(find, "toxic int, entries array<long>, kinds array<long>").collect()]
    n: Counter = Counter()
    for toxic, hits in seen:
        strongest = min((k for _, k in hits), default=None)
        for entry, kind in hits:
            if kind == strongest:  # weaker matches say little beside stronger ones
                n[entry, kind, toxic] += 1

    def share(entry: int, kind: int, bad_prior: float, good_prior: float) -> float:
        x, y = n[entry, kind, 1] + bad_prior, n[entry, kind, 0] + good_prior
        return x / (x + y)

    weights = [(share(k, EXACT, 0.6, 0.4), share(k, FUZZY, 0.7, 0.3), share(k, QUOTED, 0.1, 0.9)) for k in range(len(matcher.entries))]
    model = Model(matcher, weights, [])
    if seen:
        model.slopes = _logistic(np.array([model.evidence(h) for _, h in seen]), np.array([t for t, _ in seen], float))
    else:
        model.slopes = [-4.0, 1.0, 0.0, 0.0]
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read.

    Returns for every row ``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``n_matches`` (entries
    found). Null and empty texts get the score of texts without a match. Ties don't occur, repeated rows give repeated
    results, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _text.batches(source):
            scores, matches = [], []
            for text in batch.column(1).to_pylist():
                value, n = model.score(text)
                scores.append(value)
                matches.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(matches, pa.int64())], names=["doc_id", "score", "predicted", "n_matches"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
