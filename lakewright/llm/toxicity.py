"""Toxicity through a noisy channel: restore obfuscated words, then score.

The channel turns an intended word into what is written: letters become look-
alike signs, are repeated, or are pulled apart by marks and white space.  What
is written is a lattice of characters in which white space is dropped or ends
a word; Viterbi search finds the restored words that a character language
model and the channel's costs make likeliest.  A token with no look-alike,
mark or doubled letter has one path only, itself.

The language model holds the exact counts of character 4-grams and of their
contexts over ALL documents, in a staged table that grows with the input; the
4-grams that a bucket of distinct tokens can come to are joined to it.  Weights
of words and word beginnings come from a bounded sample of labelled documents
(``per_class`` of either class, a fixed parameter): smoothed log odds over the
documents that have them.  A document's evidence is the sum and the maximum
of its distinct restored words' weights, turned into a score by logistic
regression.  Only tokens (or neighbouring tokens, joined) whose lattice holds
something that weighs are decoded for it: others weigh nothing however read.

Null and empty texts have no evidence and a low score; repeated rows score
alike; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.labelled import fold, training_sample, with_texts

PER_CLASS = 4_000
MIN_DOCS = 3
BUCKET = 1_000                      # distinct tokens decoded together
# What a written sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = ".-_*~'`"
SUBSTITUTION, COLLAPSE, DROP = 0.7, 0.4, 0.5
_EDGE = "".join(c for c in "!|+(.,;:?\"')[]{}<>#%&*=~`^/\\-_$@€£")
_NEUTRAL = "".join(c for c in _EDGE if c not in LOOKALIKES)
_ODD = re.compile(r"([^\W\d_])\1|[" + re.escape("".join(LOOKALIKES) + MARKS) + "]")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SINGLE = re.compile(r"[^\W\d_]|[0134578@$!|]")


def readings(token: str) -> tuple[list[str], list[str]]:
    """A written token's plain words, and the texts to decode: the token
    without what surrounds it, and with the surrounding signs that may be
    letters, at either end or both."""
    core = token.strip(_EDGE)
    if core == token and core.isalpha():
        return [core], [core] if _ODD.search(core) else []
    inner = token.strip(_NEUTRAL)
    odd = dict.fromkeys((core, inner.rstrip(_EDGE), inner.lstrip(_EDGE), inner.rstrip("!"), inner))
    return ([x for x in re.split(r"[^\w]+", core) if x.isalpha()], [x for x in odd if x and _ODD.search(x)])


def _single(token: str) -> bool:
    return _SINGLE.fullmatch(token.strip(_NEUTRAL)) is not None


def _run_around(tokens: list[str], i: int, j: int) -> tuple[int, int]:
    """The run of single characters that holds places i to j - 1; a comma or
    the like ends it."""
    while i and tokens[i - 1][-1] not in ",;:?" and _single(tokens[i - 1]):
        i -= 1
    while j < len(tokens) and tokens[j - 1][-1] not in ",;:?" and _single(tokens[j]):
        j += 1
    return i, j


def _written(tokens: list[str]) -> str:
    return " ".join(t.strip(_NEUTRAL) for t in tokens)


def runs(text: str) -> list[str]:
    """Runs of three or more single characters, whatever white space is between;
    longer ones also without the first, which may be a word of its own."""
    tokens, out, i = text.split(), [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and (j == i or tokens[j - 1][-1] not in ",;:?") and _single(tokens[j]):
            j += 1
        if j - i >= 3:
            out.append(_written(tokens[i:j]))
            if j - i > 3:
                out.append(_written(tokens[i + 1:j]))
        i = max(j, i + 1)
    return out


def spaced_runs(text: str) -> list[str]:
    """Runs of single letters, joined."""
    found = [r.replace(" ", "") for r in runs(text)]
    return [r for i, r in enumerate(found) if not i or found[i - 1][1:] != r]


# --- character language model -------------------------------------------------

def _keys(before: bytes, char: bytes) -> list[int]:
    """The 4-grams of the bytes of one more character after ``before``."""
    raw = (b"   " + before)[-3:] + char
    return [int.from_bytes(raw[i:i + 4], "big") for i in range(len(char))]


class CharModel:
    """P(character | three before it), add-k over exact counts: 4-grams by
    their number, contexts by minus theirs, less one."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.memo: dict[tuple[bytes, bytes], float] = {}

    def step(self, before: bytes, char: bytes) -> float:
        """Cost of the bytes of one more character after ``before``."""
        key = (before, char)
        v = self.memo.get(key)
        if v is None:
            n = self.counts
            v = self.memo[key] = float(sum(np.log((n.get(-(k >> 8) - 1, 0) + 12.8) / (n.get(k, 0) + 0.05))
                                           for k in _keys(before, char)))
        return v


class _Asked:
    """In a model's place: takes down what a search asks for."""

    def __init__(self):
        self.steps: set[tuple[bytes, bytes]] = set()

    def step(self, before: bytes, char: bytes) -> float:
        self.steps.add((before, char))
        return 0.0


def _asked(units: list[str]) -> list[int]:
    asked = _Asked()
    for u in units:
        decode(u, asked)
    grams = {k for s in asked.steps for k in _keys(*s)}
    return sorted(grams | {-(k >> 8) - 1 for k in grams})


class CharCounts:
    """The staged table of counts: key, n."""

    def __init__(self, table: DataFrame):
        self.table = table

    def model_of(self, units: list[str]) -> CharModel:
        """The model as far as these few units need it, on the driver."""
        keys = self.table.sparkSession.createDataFrame([(k,) for k in _asked(units)], "key long")
        return CharModel({r["key"]: r["n"] for r in self.table.join(F.broadcast(keys), "key").collect()})


def count_characters(docs: DataFrame) -> CharCounts:
    """Exact counts over every text; words stand three spaces apart, so that
    each begins in the same context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                texts = b.column("text").slice(at, 1024).to_pylist()
                words = "   ".join(["", *" ".join(texts).lower().split(), ""])
                x = np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
                new, n = np.unique((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:], return_counts=True)
                every, place = np.unique(np.concatenate([keys, new.astype(np.int64)]), return_inverse=True)
                totals = np.bincount(place, np.concatenate([totals, n]), len(every)).astype(np.int64)
                keys = every
                if len(keys) > 500_000:
                    yield pa.RecordBatch.from_pydict({"key": keys, "n": totals})
                    keys, totals = keys[:0], totals[:0]
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(totals, pa.int64())})
    grams = stage(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    contexts = grams.groupBy((-F.shiftright("key", 8) - 1).alias("key")).agg(F.sum("n").alias("n"))
    return CharCounts(stage(grams.unionByName(contexts), "characters"))


def decode(token: str, model) -> str:
    """Viterbi search over the lattice of a token or of tokens with spaces in
    between.  A state is the last three bytes restored and the last written
    letter, so at most the readings of a few positions; none is dropped."""
    if isinstance(model, CharCounts):
        model = model.model_of([token])
    best: dict[tuple, tuple[float, tuple]] = {(b"", ""): (0.0, ())}
    for ch in token:
        ways = [(ch, 0.0 if ch.isalpha() else 1.5)] + [(x, SUBSTITUTION) for x in LOOKALIKES.get(ch, "")]
        if ch in MARKS:
            ways = [("", DROP)]
        if ch == " ":
            ways = [("", DROP), (" ", 0.0)]
        now: dict[tuple, tuple[float, tuple]] = {}
        for (tail, last), (cost, word) in best.items():
            for out, price in ways:
                steps = [(out, price)]
                if out and out == last and out != " ":
                    steps.append(("", COLLAPSE))               # a repeated letter may be one
                for x, p in steps:
                    raw = x.encode("utf-8", "surrogatepass")
                    total = cost + p + (model.step(tail, raw) if raw else 0.0)
                    key = (b"", "") if x == " " else ((tail + raw)[-3:], out or last)
                    if key not in now or total < now[key][0]:
                        now[key] = (total, (word, x) if x else word)
        best = now
    word = min((c + model.step(t, b" "), t, last, w) for (t, last), (c, w) in best.items())[3]
    out = []
    while word:
        word, x = word
        out.append(x)
    return "".join(reversed(out))


def restore(units: DataFrame, counts: CharCounts) -> DataFrame:
    """(unit, restored) of the distinct units: each bucket of them gets the
    counts its lattices can ask for."""
    units = stage(units.select("unit").distinct(), "units")
    n = max(1, -(-units.count() // BUCKET))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(n)))

    def ask(table: pa.Table) -> pa.Table:
        keys = _asked(table.column("unit").to_pylist())
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(keys), pa.int64()),
                         "key": pa.array(keys, pa.int64())})

    def answer(units: pa.Table, counts: pa.Table) -> pa.Table:
        model = CharModel(dict(zip(counts.column("key").to_pylist(), counts.column("n").to_pylist())))
        written = units.column("unit").to_pylist()
        return pa.table({"unit": pa.array(written, pa.string()), "restored": pa.array([decode(u, model) for u in written], pa.string())})
    asked = units.groupBy("bucket").applyInArrow(ask, "bucket long, key long")
    known = asked.join(counts.table, "key").select("bucket", "key", "n")
    return units.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "unit string, restored string")


# --- words to scores ----------------------------------------------------------

def _parts(word: str) -> list[str]:
    """A word's features: itself and its beginnings of 3 to 6 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]


def units_of(text: str) -> set[str]:
    """What of a text is decoded: odd tokens and runs of single characters."""
    return {o for w in set(text.split()) for o in readings(w)[1]}.union(runs(text))


def words_of_text(text: str, restored: dict[str, str]) -> set[str]:
    """A text's plain words and the restored words of its units."""
    text = text.lower()
    plain = {x for w in set(text.split()) for x in readings(w)[0]}
    return plain.union(*[restored[u].split() for u in units_of(text)])


_NOTHING = (None, (), None)
_START = frozenset([("", "")])


class _Node:
    """Where a walk through the lattice can be: (letters so far, last written
    letter).  ``next``: by the sign that follows, the node it leads to, None
    if nothing that weighs begins so, True if a beginning that weighs is there."""

    __slots__ = ("states", "whole", "next")

    def __init__(self, states: frozenset, whole: bool):
        self.states, self.whole, self.next = states, whole, {}


class ToxicityModel:
    """Weights of words and beginnings behind the channel.  What a token of
    the text comes to is kept for the worker (``size`` tokens)."""

    def __init__(self, counts: CharCounts | None, weights: dict[str, float], calibration: np.ndarray, size: int = 100_000):
        self.counts, self.weights, self.calibration, self.size = counts, weights, calibration, size
        self.begin_weight = {p[1:]: v for p, v in weights.items() if p[0] == "^"}
        self.weight_of = {p[1:]: v for p, v in weights.items() if p[0] == "="}
        self.begin, self.whole = set(self.begin_weight), set(self.weight_of)
        self.alive = {w[:n] for w in self.begin | self.whole for n in range(len(w) + 1)}
        self.known: dict[str, tuple] = {}
        self.nothing: set[str] = set()                     # tokens that come to nothing: most of them
        self.nodes: dict[frozenset, _Node] = {}
        self.edges = 0

    def __getstate__(self):                                # the table and what is known stay at home
        return {**self.__dict__, "counts": None, "known": {}, "nothing": set(), "nodes": {}, "edges": 0}

    def _node(self, states: frozenset) -> _Node:
        if states not in self.nodes:
            self.nodes[states] = _Node(states, any(at in self.whole for at, _ in states))
        return self.nodes[states]

    def _follow(self, node: _Node, ch: str) -> _Node | None | bool:
        """The node that ``ch`` leads to, worked out once."""
        now = set(node.states) if ch in MARKS else set()
        hit = False
        for at, last in node.states if ch not in MARKS else ():
            for out in (ch, *LOOKALIKES.get(ch, "")):
                hit = hit or at + out in self.begin
                if at + out in self.alive:
                    now.add((at + out, out))
                if out == last:
                    now.add((at, last))
        self.edges += 1
        to = node.next[ch] = True if hit else self._node(frozenset(now)) if now else None
        return to

    def _walk(self, node: _Node, written: str) -> tuple[bool, _Node | None]:
        """Follow the lattice of ``written`` from a node: whether it holds a
        beginning or word that weighs, and where it ends."""
        for ch in written:
            to = node.next.get(ch, False)
            if to is False:
                to = self._follow(node, ch)
            if to is None or to is True:
                return to is True, None
            node = to
        return node.whole, node

    def weigh(self, words: list[str]) -> tuple[str, float] | None:
        """The heaviest of some words, if any weighs."""
        best, get, begins = (0.0, ""), self.weight_of.get, self.begin_weight.get
        for w in words:
            if w[:3] in self.alive:
                weight = max(get(w, 0.0), begins(w[:3], 0.0), begins(w[:4], 0.0), begins(w[:5], 0.0), begins(w[:6], 0.0))
                best = max(best, (weight, w))
        return (best[1], best[0]) if best[0] else None

    def _look(self, token: str) -> tuple:
        """A token's heaviest plain word, those of its readings that can weigh,
        and where its letters end within something that weighs."""
        start, plain = self._node(_START), token if token.isalpha() else token.strip(_NEUTRAL)
        if plain.isalpha():
            first, second, third = (plain[:3] + "  ")[:3]
            if first != second != third and plain[:3] not in self.alive:
                return _NOTHING                         # every reading begins with these letters
            if not _DOUBLE.search(plain):               # one reading only: the word itself
                ends = plain in self.alive and not any(plain[:n] in self.begin for n in range(3, 7))
                weight = self.weigh([plain])
                return (weight, (), self._node(frozenset([(plain, plain[-1])])) if ends else None) if ends or weight else _NOTHING
            if plain[:3] not in self.alive and not _DOUBLE.search(plain[:3]):
                return _NOTHING                         # every reading begins with these letters
            weighs, ends = self._walk(start, plain)
            found = self.weigh([plain]), (plain,) if weighs else (), ends
            return found if any(found) else _NOTHING
        words, odd = readings(token)
        ends = self._walk(start, plain)[1]
        found = self.weigh(words), tuple(o for o in odd if self._walk(start, o)[0]), ends if ends is not start else None
        return found if any(found) else _NOTHING

    def _spans(self, tokens: list[str], opens: dict[str, _Node]) -> set[str]:
        """Neighbouring tokens that can weigh when joined; runs of single
        characters whole.  ``opens``: the tokens that begin something, with where they end in it."""
        out, done = set(), 0
        for i in [i for i, t in enumerate(tokens) if t in opens]:
            node, j = opens[tokens[i]], i + 1
            while node is not None and j < len(tokens):
                first = tokens[j][0]
                if node.next.get(first, False) is None and first not in _NEUTRAL:
                    break
                weighs, node = self._walk(node, tokens[j].strip(_NEUTRAL))
                j += 1
                if weighs:
                    a, z = i, j
                    if _single(tokens[j - 1]):
                        if j <= done:                          # in a run taken whole
                            break
                        a, z = _run_around(tokens, i, j)
                        done = z
                        out.add(_written(tokens[i:z]))         # what comes before may be words of their own
                    out.add(_written(tokens[a:z]))
                    break
        return out

    def prepare(self, text: str) -> tuple[int, list[str], list[float], list[str]]:
        """Number of distinct tokens, plain words that weigh with their
        weights, and the units to decode."""
        tokens = text.lower().split()
        distinct = set(tokens)
        if len(self.known) >= self.size or self.edges >= 8 * self.size:
            self.known.clear()                             # holds nodes
        if self.edges >= 8 * self.size:
            self.nodes, self.edges = {}, 0
        if len(self.nothing) >= 4 * self.size:
            self.nothing.clear()
        found, units, opens = {}, set(), {}
        for w in distinct - self.nothing:
            known = self.known.get(w)
            if known is None:
                known = self._look(w)
                if known is _NOTHING:
                    self.nothing.add(w)
                    continue
                self.known[w] = known
            plain, odd, ends = known
            if plain:
                found[plain[0]] = plain[1]
            units.update(odd)
            if ends is not None:
                opens[w] = ends
        if opens:
            units |= self._spans(tokens, opens)
        words = sorted(found)                              # one order of summing, whatever the sets' order
        return len(distinct), words, [found[w] for w in words], sorted(units)

    def evidence(self, n: int, words: list[str], weights: list[float], units: list[str], restored: dict[str, str]) -> list[float]:
        weight = dict(zip(words, weights))
        for u in units:
            weight.update(v for w in restored[u].split() if (v := self.weigh([w])))
        return [sum(weight.values()), max(weight.values(), default=0.0), len(weight) / np.sqrt(1.0 + n), np.log1p(n) / 5]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not len(self.calibration):
            return np.zeros(len(evidence))
        x = np.column_stack([evidence, np.ones(len(evidence))])
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _log_odds(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Features at least MIN_DOCS toxic documents have, well above their share
    among the clean ones."""
    out = {}
    for g, t, c in counts:
        w = np.log((t + 0.1) / (toxic + 0.2)) - np.log((c + 0.5) / (clean + 1.0))
        if t >= MIN_DOCS and w > 2.0:
            out[g] = float(w)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0,
                 per_class: int = PER_CLASS) -> ToxicityModel:
    d = docs_of(docs)
    model = count_characters(d.select("text"))
    sample = training_sample(labels, "toxic", fold(modulus) != held, per_class)
    rows = with_texts(d, sample).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")

    def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set().union(*[units_of(t.lower()) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({"unit": pa.array(sorted(found), pa.string())})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for half, y, text in zip(*(b.column(c).to_pylist() for c in ("half", "y", "text"))):
                counts[y].update((half, p) for p in {p for w in words_of_text(text, restored) for p in _parts(w)})
        keys = [k for k in counts[1]]
        yield pa.RecordBatch.from_pydict({
            "half": pa.array([k[0] for k in keys], pa.int64()), "part": pa.array([k[1] for k in keys], pa.string()),
            "toxic": pa.array([counts[1][k] for k in keys], pa.int64())})
        keys = [k for k in counts[0]]
        yield pa.RecordBatch.from_pydict({
            "half": pa.array([k[0] for k in keys], pa.int64()), "part": pa.array([k[1] for k in keys], pa.string()),
            "toxic": pa.array([-counts[0][k] for k in keys], pa.int64())})

    sampled = stage(rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("long")), "toxic-sample")
    sizes = {(r["half"], r["y"]): r["n"] for r in sampled.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    if not any(y == 1 for _, y in sizes) or not any(y == 0 for _, y in sizes):
        return ToxicityModel(model, {}, np.empty(0))
    restored = _collected(restore(sampled.mapInArrow(odd, "unit string"), model))           # of the bounded sample
    parts = (sampled.mapInArrow(tally, "half long, part string, toxic long").groupBy("part")
             .agg(*[F.sum(F.when((F.col("half") == h) & (F.col("toxic") > 0 if y else F.col("toxic") < 0), F.abs("toxic"))
                          .otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)])
             .where(f"n01 + n11 >= {MIN_DOCS}").orderBy("part").collect())          # of the bounded sample
    n = {(h, y): sizes.get((h, y), 0) for h in (0, 1) for y in (0, 1)}

    def weights(halves) -> dict[str, float]:
        return _log_odds([(r["part"], sum(r[f"n{h}1"] for h in halves), sum(r[f"n{h}0"] for h in halves)) for r in parts],
                         sum(n[h, 1] for h in halves), sum(n[h, 0] for h in halves))
    # Each half is judged by the other half's weights, so that calibration sees honest evidence.
    cross = {h: ToxicityModel(None, weights([1 - h]), np.empty(0)) for h in (0, 1)}
    judged = _evidence(sampled.select("doc_id", "text", "half", F.col("y").cast("long").alias("y")), cross, model)
    seen = judged.orderBy("doc_id").collect()
    fit = _logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float))
    return ToxicityModel(model, weights([0, 1]), fit)


def _collected(restored: DataFrame) -> dict[str, str]:
    return {r["unit"]: r["restored"] for r in restored.collect()}


def _evidence(docs: DataFrame, models: dict[int, ToxicityModel], counts: CharCounts) -> DataFrame:
    """doc_id, y, half, x (the evidence) of doc_id, text, half, y: each text
    is read once, then what can weigh is decoded over the whole table."""
    schema = "doc_id long, half long, y long, n long, words array<string>, weights array<double>, units array<string>"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [models[h].prepare(t) for h, t in zip(part.column("half").to_pylist(), part.column("text").to_pylist())]
                n, words, weights, units = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "half": part.column("half"), "y": part.column("y"), "n": pa.array(n, pa.int64()),
                    "words": pa.array(words, pa.list_(pa.string())), "weights": pa.array(weights, pa.list_(pa.float64())),
                    "units": pa.array(units, pa.list_(pa.string()))})
    prepared = stage(docs.mapInArrow(prepare, schema).withColumn("row", F.monotonically_increasing_id()), "evidence")

    def weighing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [any(m.weigh([w]) for m in models.values() for w in r.split()) for r in b.column("restored").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
    # Distinct spellings that restore to something that weighs; all others come to nothing.  They
    # go back to the texts by a join: how many there are grows with the corpus.
    restored = restore(prepared.select(F.explode("units").alias("unit")), counts).mapInArrow(weighing, "unit string, restored string")
    told = (prepared.select("row", F.explode("units").alias("unit")).join(restored, "unit")
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("unit", "restored"))).alias("told")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = []
            for h, n, words, weights, told in zip(*(b.column(c).to_pylist() for c in ("half", "n", "words", "weights", "told"))):
                restored = {t["unit"]: t["restored"] for t in told or ()}
                x.append(models[h].evidence(n, words, weights, list(restored), restored))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"),
                                              "x": pa.array(x, pa.list_(pa.float64()))})
    return prepared.drop("units").join(told, "row", "left").mapInArrow(judge, "doc_id long, y long, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, modulus: int = 5, held: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(model.score(x), pa.float64())})
    d = docs_of(docs).withColumn("half", F.lit(0).cast("long")).withColumn("y", F.lit(0).cast("long"))
    return (_evidence(d, {0: model}, model.counts).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", F.coalesce(fold(modulus) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
