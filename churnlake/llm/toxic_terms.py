"""Toxicity: a learned lexicon matched with Levenshtein automata, weighed by context windows.

Terms are learned from labelled documents: words, and stems that words share, whose contexts
(neighbouring words) are far more often toxic than chance; copies of a document share their
contexts and so count once. The terms' trie and their Levenshtein automata form one automaton that
is made deterministic as words are read, so a word costs a look-up per letter, misspelled or not.
A window around each hit tells quotation from abuse: quoted or reported terms count apart from
others, and terms near an address to the reader count more. A logistic curve over these counts
gives the score.

Null and empty texts have no hits. Without labels of both classes every score is 0. Repeated rows
get equal scores. Extra columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan
from churnlake.session import checkpoint

SAMPLE = 20_000         # labelled documents that terms and curve are learned from
TERMS, STEMS = 5_000, 500
LEAST_CONTEXTS = 3
SURPRISE, STEM_SURPRISE = 25.0, 60.0    # log likelihood ratio of a term and of a stem
PURE, STEM_PURE = 0.8, 0.98             # least share of toxic contexts
STEM_SIZES = (4, 5, 6, 7)
WINDOW = 8              # words on either side of a hit
THRESHOLD = 0.7
CACHE = 500_000         # words and transitions remembered by a task

_WORD = re.compile(r"[\w@$*!']+")
_TRIM = "@$*!'_"
_QUOTES = re.compile("[\"“”„«»‹›]")
# Words that report what another said, and that address the reader, in the languages of the corpus.
_REPORTS = frozenset("said says wrote quoted quote called reported sagte schrieb zitat nannte dit écrit cité dijo escribió citó".split())
_ADDRESS = frozenset("you your youre du dich dein ihr tu toi vous te ton usted tú ti".split())


def tokens(text: str) -> list[str]:
    return [t for w in _WORD.findall(text.lower()) if (t := w.strip(_TRIM))]


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of all terms over their trie; states are made as they are met."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[int, float] | None] = [None]
        self.stem: list[float | None] = [None]
        self.most = [0]  # errors that some term below allows
        for words, is_stem in ((terms, False), (stems, True)):
            for word, weight in words.items():
                k = 0 if is_stem else errors_allowed(word)
                node = 0
                self.most[0] = max(self.most[0], k)
                for c in word:
                    to = self.children[node].get(c)
                    if to is None:
                        to = self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.most.append(0)
                    node = to
                    self.most[node] = max(self.most[node], k)
                if is_stem:
                    self.stem[node] = weight
                else:
                    self.term[node] = (k, weight)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[tuple[int, str], int] = {}
        self.start = self.state(self.skipped({0: 0}))

    def state(self, places: dict[int, int]) -> int:
        key = tuple(sorted(places.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def skipped(self, places: dict[int, int]) -> dict[int, int]:
        """With the places that are reached by leaving out letters of a term."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue  # a met stem has no letters left to leave out
            for to in self.children[node].values():
                if e + 1 <= self.most[to] and places.get(to, 9) > e + 1:
                    places[to] = e + 1
                    todo.append((to, e + 1))
        return places

    def next(self, state: int, c: str) -> int:
        places: dict[int, int] = {}
        for node, e in self.states[state]:
            if node < 0:
                places[node] = 0  # a stem was met: the rest of the word is free
                continue
            for letter, to in self.children[node].items():
                cost = e if letter == c else e + 1
                if cost <= self.most[to] and places.get(to, 9) > cost:
                    places[to] = cost
                    if cost == 0 and self.stem[to] is not None:
                        places[-to] = 0
            if e + 1 <= self.most[node] and places.get(node, 9) > e + 1:
                places[node] = e + 1
        return self.state(self.skipped(places)) if places else -1

    def match(self, word: str) -> tuple[int, float] | None:
        """``(errors, weight)`` of the nearest term; errors 3 stands for a stem."""
        if len(self.step) > CACHE:
            self.forget()
        state, step = self.start, self.step
        for c in word:
            key = (state, c)
            to = step.get(key)
            if to is None:
                to = step[key] = self.next(state, c)
            if to < 0:
                return None
            state = to
        best = None
        for node, e in self.states[state]:
            found = None
            if node < 0:
                found = (3, self.stem[-node])
            elif self.term[node] is not None and e <= self.term[node][0]:
                found = (e, self.term[node][1])
            if found and (best is None or (found[0], -found[1]) < (best[0], -best[1])):
                best = found
        return best


FEATURES = 6


@dataclass
class Lexicon:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._automaton, self._clean, self._hits = None, set(), {}

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def features(self, text: str | None) -> list[float]:
        """Log counts of exact, once and twice misspelled, stem and quoted hits; and of hits near an address."""
        out = [0.0] * FEATURES
        if not text or not (self.terms or self.stems):
            return out
        if self._automaton is None:
            self._automaton = Automaton(self.terms, self.stems)
        words = tokens(text)
        met = set(words)
        for w in met - self._clean - self._hits.keys():
            found = self._automaton.match(w)
            if found is None:
                self._clean.add(w)
            else:
                self._hits[w] = found
        hits = met & self._hits.keys()
        if len(self._clean) > CACHE:
            self._clean.clear()
        if len(self._hits) > CACHE:
            known, self._hits = self._hits, {}
        else:
            known = self._hits
        if not hits:
            return out
        quoted = self.quoted_words(text)
        for k, w in enumerate(words):
            if w not in hits:
                continue
            errors, _ = known[w]
            near = words[max(0, k - WINDOW):k + WINDOW + 1]
            if k in quoted or any(x in _REPORTS for x in near):
                out[4] += 1
            else:
                out[errors] += 1
                out[5] += any(x in _ADDRESS for x in near)
        return [math.log1p(x) for x in out]

    @staticmethod
    def quoted_words(text: str) -> set[int]:
        """Numbers of the words between two quotation marks of one line."""
        if not _QUOTES.search(text):
            return set()
        out: set[int] = set()
        n = 0
        for line in text.split("\n"):
            parts = _QUOTES.split(line)
            for i, part in enumerate(parts):
                count = len(tokens(part))
                if i % 2 and i < len(parts) - 1:
                    out.update(range(n, n + count))
                n += count
        return out

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning ------------------------------------------------------------------------------------

# Where the curve starts and is drawn to: bias, then the features in order.
PRIOR = (-3.0, 3.0, 2.0, 1.0, 3.0, 0.3, 0.5)


def _contexts(text: pa.Array) -> pa.Array:
    """Distinct ``(word, context)`` of each text; the context is a hash of the words on both sides."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("context", pa.int64())]))
    out = []
    for t in text.to_pylist():
        words = tokens(t or "")
        joined = pa.array([f"{a}|{b}" for a, b in zip(["", *words], [*words[1:], ""])], pa.large_string())
        part = next(scan.parts(joined, 1 << 40), None)
        hashed = scan.hashes(part.data, part.bounds[:-1], part.bounds[1:]).view(np.int64).tolist() if part else []
        out.append([{"word": w, "context": c} for w, c in set(zip(words, hashed)) if len(w) > 2])
    return pa.array(out, kind)


def _surprise(pos: Column, neg: Column, share: Column) -> Column:
    n = pos + neg
    return 2 * (pos * F.log((pos + 1e-9) / (n * share)) + neg * F.log((neg + 1e-9) / (n * (1 - share))))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Terms, stems and curve from ``(doc_id, text, toxic)``; at most ``sample`` rows, chosen by hash."""
    known = labelled.filter(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    known = checkpoint(known)
    seen = known.select("toxic", F.explode(arrow_udf(_contexts, "array<struct<word:string,context:bigint>>")("text")).alias("w"))
    once = seen.groupBy("w.word", "w.context").agg(F.max("toxic").alias("pos"), F.min("toxic").alias("least"))
    words = checkpoint(once.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("least")).alias("neg")))
    totals = words.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return Lexicon({}, {})
    share = totals["p"] / (totals["p"] + totals["n"])
    rate = F.lit(share)

    def best(rows: DataFrame, name: str, surprise: float, pure: float, most: int) -> dict[str, float]:
        pos, neg = F.col("pos"), F.col("neg")
        good = rows.filter((pos >= LEAST_CONTEXTS) & (pos >= pure * (pos + neg)) & (pos > share * (pos + neg))).withColumn(
            "g", _surprise(pos, neg, rate)).filter(F.col("g") >= surprise)
        return {r[name]: float(r["g"]) for r in good.orderBy(F.desc("g"), name).limit(most).collect()}

    prefixes = words.filter("pos > 0 or neg > 0").select(
        F.explode(F.array(*[F.when(F.char_length("word") > n, F.substring("word", 1, n)) for n in STEM_SIZES])).alias("stem"), "pos", "neg").filter(
        "stem is not null").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("words")).filter("words >= 3")
    stems = best(prefixes, "stem", STEM_SURPRISE, STEM_PURE, STEMS)
    stems = {s: g for s, g in stems.items() if not any(s[:n] in stems for n in range(min(STEM_SIZES), len(s)))}
    terms = {w: g for w, g in best(words, "word", SURPRISE, PURE, TERMS).items() if not any(w[:n] in stems for n in STEM_SIZES)}
    found = Lexicon(terms, stems)

    def features(text: pa.Array) -> pa.Array:
        return pa.array([found.features(t) for t in text.to_pylist()], pa.list_(pa.float64()))

    counted = known.select("toxic", arrow_udf(features, "array<double>")("text").alias("x")).groupBy("toxic", "x").count().collect()
    x = np.array([[1.0, *r["x"]] for r in counted])
    y = np.array([float(r["toxic"]) for r in counted])
    n = np.array([float(r["count"]) for r in counted])
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - (w - prior)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    found.weights = [float(v) for v in w]
    return found


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; nothing but the text is an input, and nothing is shuffled."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn("score", arrow_udf(run, "double")("text")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
