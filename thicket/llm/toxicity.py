"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

* The lexicon is learned: words that toxic training texts have and clean ones do not, and stems of words,
  which stand for every word that begins so; all that are pure and frequent enough, as a trie.
* ``LevenshteinTrie`` intersects the trie with the Levenshtein automata of all inputs at once: a state is the set
  of (node, errors) that an input can have reached, and sets that inputs reach are made rows of one table. Terms
  of ``FUZZY_FROM`` letters and more may have one error (insertion, deletion, substitution, swap). A task
  runs all words of its texts through the table side by side, a byte a step.
* Each hit is a quotation or an abuse by its context window: quotation marks open around it or a word of
  reporting beside it speak for the former, words of address for the latter.
* A text's counts of hits of each kind go through a logistic regression, fitted on a bounded sample of
  labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored
from thicket.llm._text import chunks

FOLDS, HELD_OUT = 5, 0
SAMPLE = 4000
LEAST_TEXTS = 5
PURITY = 0.97
STEMS = (4, 5, 6, 7)
LEAST_STEM_TEXTS = 8
FUZZY_FROM = 5
LONGEST = 40
WINDOW = 80
FEATURES = 6
FUZZY = 0.7
#: What speaks for quotation and for address, next to a term.
QUOTES = re.compile("[\"“”„«»]")
REPORTS = re.compile(r"\b(?:said|says|saying|called|calls|calling|quote|quotes|quoted|wrote|writes|word|words|term|terms|meaning|sagte|dit|dijo)\b", re.I)
ADDRESS = re.compile(r"\b(?:you|your|youre|u|ur|du|dich|dein|ihr|tu|toi|ton|vous|votre|usted|eres|ti)\b", re.I)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), 36, 64, *range(128, 256)]] = True
#: Look-alikes count as the letters that they stand for.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _like, _letter in zip("013457$@", "oieastsa", strict=True):
    _FOLD[ord(_like)] = ord(_letter)


def held_out(column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text divides by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters in each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last[:-1] &= ~solid[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class LevenshteinTrie:
    """A deterministic automaton over bytes: which term an input is, with at most one error."""

    def __init__(self, terms: list[bytes], fuzzy_from: int = FUZZY_FROM, stems: set[int] | None = None) -> None:
        self.stem: set[int] = set()  # nodes at which a stem is complete
        self.children: list[dict[int, int]] = [{}]
        self.term: list[int] = [-1]
        self.longest: list[int] = [0]  # letters of the longest term below, which says whether errors are allowed
        for k, term in enumerate(terms):
            at = 0
            for c in term:
                self.longest[at] = max(self.longest[at], len(term))
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.longest.append(0)
                at = self.children[at][c]
            self.longest[at] = max(self.longest[at], len(term))
            if self.term[at] < 0:
                self.term[at] = k
            if stems and k in stems:
                self.stem.add(at)
        self.lengths, self.fuzzy_from = [len(t) for t in terms], fuzzy_from
        letters = sorted({c for t in terms for c in t})
        self.letter = np.zeros(256, np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self._determinise(letters)

    def _closure(self, states: set[tuple[int, int, int]]) -> frozenset[tuple[int, int, int]]:
        """With what deletions of a term's letter lead to; the third part is a letter owed by a swap, or 0."""
        out = set(states)
        for node, errors, owed in states:
            if not errors and not owed and self.longest[node] >= self.fuzzy_from:
                out |= {(child, 1, 0) for child in self.children[node].values()}
        return frozenset(out)

    def _step(self, states: frozenset[tuple[int, int, int]], c: int) -> frozenset[tuple[int, int, int]]:
        out = set()
        for node, errors, owed in states:
            if owed:  # the other letter of a swap has to come now
                if c == owed:
                    out.add((node, 1, 0))
                continue
            if node in self.stem and not errors:
                out.add((node, 0, 0))  # whatever follows a stem
            if c in self.children[node]:
                out.add((self.children[node][c], errors, 0))
            if not errors and self.longest[node] >= self.fuzzy_from:
                out.add((node, 1, 0))  # inserted
                for letter, child in self.children[node].items():
                    if letter != c:
                        out.add((child, 1, 0))  # substituted
                        if c in self.children[child]:
                            out.add((self.children[child][c], 1, letter))  # swapped
        return self._closure({(n, e, o) for n, e, o in out if e == 0 or self.longest[n] >= self.fuzzy_from})

    def _accepted(self, states: frozenset[tuple[int, int, int]]) -> int:
        """Twice the term's number, plus its errors; -1 where no term ends."""
        found = [(e, self.term[n]) for n, e, o in states if not o and self.term[n] >= 0 and (e == 0 or self.lengths[self.term[n]] >= self.fuzzy_from)]
        return min(found)[1] * 2 + min(found)[0] if found else -1

    def _row(self, states: frozenset[tuple[int, int, int]]) -> int:
        """The number of a set of states, with a row of the table whose steps are not known yet."""
        if states not in self.number:
            n = self.number[states] = len(self.sets)
            self.sets.append(states)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accepted = np.concatenate([self.accepted, np.full_like(self.accepted, -1)])
            self.accepted[n] = self._accepted(states)
        return self.number[states]

    def _determinise(self, letters: list[int]) -> None:
        """Starts the table: rows and steps are added when an input first needs them, so a large lexicon
        costs what the texts use of it. Row 0 is the dead state."""
        self.symbols = [0, *letters]  # 0: any letter that no term has
        self.table, self.accepted = np.full((1024, len(self.symbols)), -1, np.int32), np.full(1024, -1, np.int32)
        self.number, self.sets = {}, []
        self._row(frozenset())
        self.table[0] = 0
        self._row(self._closure({(0, 0, 0)}))

    def _after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.table[state, symbol]
        new = np.flatnonzero(out < 0)
        if len(new):
            for key in np.unique(state[new].astype(np.int64) * len(self.symbols) + symbol[new]).tolist():
                n, k = divmod(key, len(self.symbols))
                self.table[n, k] = self._row(self._step(self.sets[n], self.symbols[k]))
            out = self.table[state, symbol]
        return out

    def match(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its term's number twice, plus its errors; -1 where it is none.

        Beyond the longest term's bytes and one error only stems go on, whatever follows, so the rest of
        a longer word is not read.
        """
        out = np.full(len(starts), -1, np.int32)
        live = np.arange(len(starts))
        symbol, state = self.letter[_FOLD[raw]] if len(raw) else np.zeros(0, np.int64), np.ones(len(live), np.int32)
        at, end = starts[live], np.minimum(ends, starts + max(LONGEST, max(self.lengths) + 2))[live]
        while len(live):
            state = self._after(state, symbol[at])
            at = at + 1
            done = at == end
            out[live[done]] = self.accepted[state[done]]
            go = ~done & (state > 0)
            live, at, end, state = live[go], at[go], end[go], state[go]
        return out


def _quoted(text: bytes, start: int, end: int) -> tuple[bool, bool]:
    """Whether a hit is quoted, and whether it is addressed to somebody, by its window."""
    before = text[max(0, start - WINDOW) : start].decode(errors="ignore").rsplit("\n", 1)[-1]
    after = text[end : end + WINDOW].decode(errors="ignore").split("\n", 1)[0]
    marks = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
    near = " ".join([*before.split()[-5:], "|", *after.split()[:5]])
    return marks or REPORTS.search(near) is not None, ADDRESS.search(near) is not None


def features(raw: np.ndarray, offsets: np.ndarray, trie: LevenshteinTrie | None, weights: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text: hits as abuse, as quotation and with an address, the largest
    weight, the share of hits, and whether there is abuse. A hit with an error counts ``FUZZY`` of one."""
    out = np.zeros((len(offsets) - 1, FEATURES))
    if trie is None or not len(raw):
        return out
    starts, ends = _bounds(raw, offsets)
    found = trie.match(raw, starts, ends)
    hits = np.flatnonzero(found >= 0)
    row = np.searchsorted(offsets, starts[hits], "right") - 1
    words = np.diff(np.searchsorted(starts, offsets))
    data = raw.tobytes()
    for r, hit in zip(row.tolist(), hits.tolist(), strict=True):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        quoted, addressed = _quoted(data[max(lo, int(starts[hit]) - 4 * WINDOW) : min(hi, int(ends[hit]) + 4 * WINDOW)], int(starts[hit]) - max(lo, int(starts[hit]) - 4 * WINDOW), int(ends[hit]) - max(lo, int(starts[hit]) - 4 * WINDOW))
        errors, weight = int(found[hit]) % 2, float(weights[found[hit] // 2])
        sure = FUZZY if errors else 1.0
        out[r, int(quoted)] += sure
        out[r, 2] += addressed and not quoted
        out[r, 3] = max(out[r, 3], weight * sure * (0.5 if quoted else 1.0))
    out[:, 4] = out[:, :2].sum(axis=1) / np.maximum(words, 1)
    out[:, 5] = out[:, 0] > 0
    out[:, :3] = np.log1p(out[:, :3])
    return out


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.1, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression (the first is the constant), by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *([strength] * (x.shape[1] - 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Classifier:
    """Lexicon, its automaton, and the regression's coefficients."""

    def __init__(self, terms: list[tuple[str, float]], stems: set[int] | None = None) -> None:
        self.terms = terms
        self.trie = LevenshteinTrie([t.encode() for t, _ in terms], stems=stems) if terms else None
        self.weights, self.coefficients = np.array([w for _, w in terms]), None

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return features(raw, offsets, self.trie, self.weights)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + self.features(raw, offsets) @ self.coefficients[1:], -30, 30)))


def _lexicon(rows: list) -> tuple[list[tuple[str, float]], set[int]]:
    """Terms and weights, and which are stems, from rows by falling number of texts: no word that a stem
    covers, and no stem that one word makes up."""
    terms, stems, texts = [], [], {}
    for r in rows:
        if any(r.word.startswith(s) for s in stems) or r.stem and any(w.startswith(r.word) and n >= 0.6 * r.t for w, n in texts.items()):
            continue
        if r.stem:
            stems.append(r.word)
        texts[r.word] = r.t
        terms.append((r.word, float(r.weight), r.stem))
    return [(w, x) for w, x, _ in terms], {k for k, (_, _, stem) in enumerate(terms) if stem}


def train(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> Classifier:
    """Learns from rows of ``labels`` (doc_id, toxic) outside the held-out fold.

    Lexicon and regression use at most ``SAMPLE`` toxic and ``SAMPLE`` clean rows, picked by a hash of the id; the
    constant is then set to the share of toxic labels. Labels without text, or null, are not used; an id with
    several labels counts as toxic if one says so. Without labels of both kinds every score is 0.
    """
    folder = folder or shared_folder(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, f"{folder}/labels")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        some = part if some is None else some.union(part)
    some = stored(some, f"{folder}/sample-ids").withColumnRenamed("doc_id", "known")  # at most 2 * SAMPLE rows
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("known")).select("text", "toxic")
    sample = stored(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), f"{folder}/sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int32)
            for lo, hi, raw, offsets in chunks(batch.column(0)):
                starts, ends = _bounds(raw, offsets)
                keep = ends - starts >= 3
                starts, ends = starts[keep], ends[keep]
                row, data = np.searchsorted(offsets, starts, "right") - 1, _FOLD[raw].tobytes()
                whole = {(r, data[s:e]) for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True)}
                every = [(r, w.decode(errors="replace")) for r, w in whole]
                found = [(r, w, False) for r, w in every if len(w) <= LONGEST]
                found += {(r, w[:n], True) for r, w in every for n in STEMS if len(w) > n}
                yield pa.record_batch([pa.array([w for _, w, _ in found], pa.string()), pa.array([k for _, _, k in found], pa.bool_()), pa.array(toxic[lo:hi][[r for r, _, _ in found]] if found else [], pa.int32())], names=["word", "stem", "toxic"])

    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Classifier([])
    of = sample.mapInArrow(words, "word string, stem boolean, toxic int").groupBy("word", "stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    rate, other = F.col("t") / n[1], F.col("c") / n[0]
    of = of.where((F.col("t") >= F.when(F.col("stem"), LEAST_STEM_TEXTS).otherwise(LEAST_TEXTS)) & (rate / (rate + other) >= PURITY)).withColumn("weight", F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1)))
    classifier = Classifier(*_lexicon(of.orderBy(F.desc("t"), "stem", "word").collect()))  # words of at least LEAST_TEXTS of the sample's texts
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1)
            for lo, hi, raw, offsets in chunks(batch.column(0)):
                rows = sent.value.features(raw, offsets)
                yield pa.record_batch([pa.array(rows.tolist(), pa.list_(pa.float64())), toxic.slice(lo, hi - lo)], names=["x", "toxic"])

    rows = sample.mapInArrow(described, "x array<double>, toxic int").collect()  # at most 2 * SAMPLE rows
    rows.sort(key=lambda r: (r.x, r.toxic))
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    w = fit(x, y)
    w[0] += np.log(counts.get(1, 1) / counts.get(0, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    classifier.coefficients = w
    return classifier


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no hits, and the score of such texts. Repeated and null ids are rows of their
    own; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # its lexicon is bounded by the sample of labelled texts
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                p = sent.value.score(raw, offsets)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
