"""Secret scans: patterns, and formats learned by grammar inference.

Three patterns give the base spans. Their values are the labelled credentials from which the formats are
learned, all distinct ones: for each kind an automaton whose states are the last ``HISTORY`` symbols read, the
start of a value being one, with counts of what follows them, summed in tasks. There are at most as many
states as such histories, however many values. States are merged wherever their frequencies of ending
and of going on are compatible (Hoeffding bound), the most frequent first, each with the states that were kept
before. What remains is a probabilistic automaton. One more is learned from long words and long
numbers, runs of letters only or of digits only: the background.

Every candidate, a piece of 16 or more characters of ``A-Za-z0-9+/_.=-`` that base spans leave of a run of such
characters, is scored by the automata: the largest log2 likelihood of a format less that of the
background, per character. Those above a threshold, which lies between what labelled credentials and
background runs reach, are added as spans of the kind ``format``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored

KINDS = ("assign", "access", "hex")
PLAIN = "plain"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 6, "access": 20, "hex": 24}
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST_RUN = 16
#: Symbols that a state remembers before states are merged.
HISTORY = 3
#: Steps of a bit in which scores are counted for the threshold.
STEPS = 1024
ALPHA = 0.05
SMOOTH = 0.05
START, END = "^", "$"
#: Symbols of the automata: classes of characters.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", ".", "=")
CLASS_OF = {ord(c): chr(97 + k) for k, chars in enumerate(CLASSES) for c in chars}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, leftmost and not overlapping within a kind."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for run in RUN.finditer(text):  # a run of hex digits lies in a run of these characters
        if run.end() - run.start() >= LEAST["hex"]:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the pieces that ``spans``, in order, leave of the runs; one pass over both."""
    out, k = [], 0
    for run in RUN.finditer(text):
        at, end = run.span()
        while k < len(spans) and spans[k][0] < end:
            if spans[k][2] > at:
                if spans[k][0] - at >= LEAST_RUN:
                    out.append((at, spans[k][0]))
                at = spans[k][2]
            if spans[k][2] > end:  # it may reach into the next run
                break
            k += 1
        if end - at >= LEAST_RUN:
            out.append((at, end))
    return out


def symbols(value: str) -> str:
    """One symbol for each character; others than the classes' have none of the automata's symbols."""
    return value.translate(CLASS_OF)


def followers(value: str) -> Iterator[tuple[str, str]]:
    """(history, symbol) of each place in a value, the end being one."""
    word = START + symbols(value) + END
    return ((word[max(0, i - HISTORY) : i], word[i]) for i in range(1, len(word)))


class Automaton:
    """A probabilistic automaton: for each state its visits, its ends, and the next state by symbol.

    It is learned from ``values``, or from ``counts`` of what ``followers`` gives for them.
    """

    def __init__(self, values: list[str] = (), alpha: float = ALPHA, counts: dict[tuple[str, str], int] | None = None) -> None:
        counts = counts or Counter(f for value in values for f in followers(value))
        names = {h: k for k, h in enumerate(sorted({START} | {h for h, _ in counts}, key=lambda h: (h != START, h)))}
        self.visits, self.ends = [0] * len(names), [0] * len(names)
        self.next, self.times = [{} for _ in names], [{} for _ in names]
        for (history, symbol), n in sorted(counts.items()):
            at = names[history]
            self.visits[at] += n
            if symbol == END:
                self.ends[at] += n
            else:
                self.times[at][symbol] = n
                self.next[at][symbol] = names[(history + symbol)[-HISTORY:]]
        self.scale = math.sqrt(math.log(2 / alpha) / 2)
        self.merged = list(range(len(names)))
        self._merge_states()

    def _state(self, k: int) -> int:
        while self.merged[k] != k:
            self.merged[k] = k = self.merged[self.merged[k]]
        return k

    def _differs(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        waiting, seen = [(p, q)], {(p, q)}
        while waiting:
            p, q = waiting.pop()
            n, m = self.visits[p], self.visits[q]
            if self._differs(self.ends[p], n, self.ends[q], m):
                return False
            for s in self.next[p].keys() | self.next[q].keys():
                if self._differs(self.times[p].get(s, 0), n, self.times[q].get(s, 0), m):
                    return False
                if s in self.next[p] and s in self.next[q]:
                    pair = self._state(self.next[p][s]), self._state(self.next[q][s])
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        waiting.append(pair)
        return True

    def _fold(self, into: int, other: int) -> None:
        waiting = [(into, other)]
        while waiting:
            p, q = (self._state(k) for k in waiting.pop())
            if p == q:
                continue
            p, q = min(p, q), max(p, q)  # the start stays the first
            self.merged[q] = p
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for s, target in self.next[q].items():
                self.times[p][s] = self.times[p].get(s, 0) + self.times[q][s]
                if s in self.next[p]:
                    waiting.append((self.next[p][s], target))
                else:
                    self.next[p][s] = target

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            border = {self._state(t) for p in kept for t in self.next[p].values()} - set(kept)
            if not border:
                break
            new = max(border, key=lambda t: (self.visits[t], -t))
            for state in kept:
                if self._compatible(state, new):
                    self._fold(state, new)
                    kept = list(dict.fromkeys(self._state(k) for k in kept))
                    break
            else:
                kept.append(new)
        for p in kept:
            self.next[p] = {s: self._state(t) for s, t in self.next[p].items()}

    def states(self) -> int:
        seen, waiting = {0}, [0]
        while waiting:
            new = set(self.next[waiting.pop()].values()) - seen
            seen |= new
            waiting += new
        return len(seen)

    def likelihood(self, value: str) -> float:
        """log2 of the smoothed probability of a value, without its end: values may go on in other formats."""
        at, total = 0, 0.0
        for s in symbols(value):
            if at < 0:
                total += math.log2(SMOOTH / (len(CLASSES) + 1))
                continue
            n = self.visits[at]
            total += math.log2((self.times[at].get(s, 0) + SMOOTH) / (n + SMOOTH * (len(CLASSES) + 1)))
            at = self.next[at].get(s, -1)
        return total


def _ranked(steps: dict[int, int], rank: int) -> int:
    """The step of the value with so many before it."""
    for step in sorted(steps):
        rank -= steps[step]
        if rank < 0:
            return step
    raise ValueError("fewer values than the rank asks for")


class Formats:
    """The automata of the kinds and of the background, and the threshold between them."""

    def __init__(self, labelled: dict[str, list[str]], background: list[str]) -> None:
        self._learn({k: Automaton(v) for k, v in sorted(labelled.items()) if v}, Automaton(background) if background else None)
        self.part(Counter(self.step(v) for vs in labelled.values() for v in vs), Counter(self.step(v) for v in background))

    def _learn(self, kinds: dict[str, Automaton], background: Automaton | None) -> None:
        self.kinds, self.threshold = kinds, math.inf
        self.background = background or Automaton(["aaaaaaaaaaaaaaaa"])

    @classmethod
    def counted(cls, counts: dict[str, dict[tuple[str, str], int]]) -> Formats:
        """From the ``followers`` of each kind's values and of those of ``PLAIN``, without a threshold as yet."""
        formats = cls.__new__(cls)
        made = {k: Automaton(counts=c) for k, c in sorted(counts.items()) if c}
        background = made.pop(PLAIN, None)
        formats._learn(made, background)
        return formats

    def step(self, value: str) -> int | None:
        """The step of 1 / ``STEPS`` bits that a value's score lies in; without formats there is none."""
        return math.floor(self.score(value)[0] * STEPS) if self.kinds else None

    def part(self, own: dict[int, int], other: dict[int, int]) -> None:
        """Sets the threshold by how many credentials (``own``) and background runs lie in each step."""
        if not self.kinds:
            return
        low = _ranked(own, sum(own.values()) // 100) / STEPS if own else math.inf
        n = sum(other.values())
        high = (_ranked(other, n - 1 - n // 1000) + 1) / STEPS if other else -math.inf
        self.threshold = (low + high) / 2 if high < low < math.inf and high > -math.inf else max(low, high)

    def score(self, value: str) -> tuple[float, str]:
        """Bits per character that the best format says more for a value than the background, and that format."""
        if not self.kinds:
            return -math.inf, ""
        plain = self.background.likelihood(value)
        return max(((a.likelihood(value) - plain) / max(len(value), 1), k) for k, a in self.kinds.items())


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, starts, kinds, ends, values, at, runs, plain): base spans and their values, candidates, and
    the distinct candidates of letters only or digits only, of which the background is learned."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "starts", "kinds", "ends", "values", "at", "runs", "plain"]
    types = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some, rows = batch.slice(lo, 1000), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    text = text or ""
                    spans = base_spans(text)
                    values = [ASSIGN.match(text, s)[2] if k == 0 else text[s:e] for s, k, e in spans]
                    more = candidates(text, spans)
                    plain = sorted({text[s:e] for s, e in more if text[s:e].isalpha() or text[s:e].isdigit()})
                    rows.append(([s for s, _, _ in spans], [k for _, k, _ in spans], [e for _, _, e in spans], values, [s for s, _ in more], [text[s:e] for s, e in more], plain))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.record_batch([some.column(0), *columns], names=names)

    schema = f"doc_id {kind}, starts array<long>, kinds array<int>, ends array<long>, values array<string>, at array<long>, runs array<string>, plain array<string>"
    return docs.mapInArrow(run, schema)


def learn(found: DataFrame, folder: str) -> Formats:
    """Formats from all distinct values of each kind and all distinct runs of the background, and the threshold
    from all their scores. Tasks count what follows each history, and then how many scores lie in each step:
    both have as many rows as there are histories and steps, whatever the number of values. Without any run of the
    background it is a run of one letter."""
    pairs = found.select(F.explode(F.arrays_zip("kinds", "values")).alias("p"))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("p.kinds"))
    plain = found.select(F.lit(PLAIN).alias("kind"), F.explode("plain").alias("v"))
    values = stored(pairs.select(name.alias("kind"), F.col("p.values").alias("v")).union(plain).distinct(), f"{folder}/values")

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((kind, h, s) for h, s in followers(value))
        if counts:
            kinds, before, after = map(list, zip(*counts, strict=True))
            yield pa.record_batch([pa.array(kinds), pa.array(before), pa.array(after), pa.array(list(counts.values()), pa.int64())], names=["kind", "history", "symbol", "n"])

    rows = values.mapInArrow(histories, "kind string, history string, symbol string, n long").groupBy("kind", "history", "symbol").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[tuple[str, str], int]] = {}
    for r in rows.collect():  # bounded by the histories
        counts.setdefault(r.kind, {})[r.history, r.symbol] = r.n
    formats = Formats.counted(counts)
    if not formats.kinds:
        return formats
    sent = found.sparkSession.sparkContext.broadcast(formats)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = sent.value, Counter()
        for batch in batches:
            counts.update((kind == PLAIN, model.step(v)) for kind, v in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if counts:
            other, step = map(list, zip(*counts, strict=True))
            yield pa.record_batch([pa.array(other), pa.array(step, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["other", "step", "n"])

    rows = values.mapInArrow(steps, "other boolean, step long, n long").groupBy("other", "step").agg(F.sum("n").alias("n")).collect()
    formats.part({r.step: r.n for r in rows if not r.other}, {r.step: r.n for r in rows if r.other})
    return formats


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: Formats | None = None, folder: str | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    base_sha256 is of the base spans as kind:start:end (code points, end exclusive), joined by commas, by start
    and then kind; spans are these and those that the formats add. Null and empty texts have none. Repeated
    and null ids are rows of their own; other columns are not read. Without any credential to learn from,
    only base spans are found.
    """
    import hashlib

    folder = folder or shared_folder(docs.sparkSession, "secrets")
    found = stored(_found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), f"{folder}/found")
    formats = formats or learn(found, folder)
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by the histories
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = []
            for starts, kinds, ends, at, runs in zip(*(batch.column(c).to_pylist() for c in ("starts", "kinds", "ends", "at", "runs")), strict=True):
                spans = list(zip(starts, kinds, ends, strict=True))
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                more = [(s, len(KINDS), s + len(v)) for s, v in zip(at, runs, strict=True) if model.score(v)[0] >= model.threshold]
                every = ",".join(f"{(*KINDS, 'format')[k]}:{s}:{e}" for s, k, e in sorted(spans + more))
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), every, len(more)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    rows = found.select("doc_id", "starts", "kinds", "ends", "at", "runs")
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
