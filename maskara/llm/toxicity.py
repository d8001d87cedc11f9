"""Toxicity scores from a lexicon trie run through Levenshtein automata.

Lexicon: terms that mark toxic documents among labelled ones. Every word (letters, lower case) and every prefix of
four to forty letters is counted by document and label over a bounded sample of labelled rows; those far commoner in
toxic documents become whole-word terms or stems, the best ``MOST_TERMS`` of them.

Matching: the terms form a trie, and its product with the Levenshtein automaton for one edit is made deterministic as
words need it: a state is the set of (trie node, edits so far) that a word's beginning can reach, so a word is read
letter by letter and dropped at the first dead state. Whole-word terms of ``FUZZY_LETTERS`` letters or more are
matched with up to one edit, shorter ones and stems exactly. Each distinct word is matched once a worker.

Context: each hit is looked at with a window of its text. Within quotation marks, or near a word of reporting, it
counts as quoted, else as abuse. A document's sums of exact, misspelled and quoted hits, their share of its words and the
number of different terms are the inputs of a logistic model fitted on the same sample.

Nulls and odd rows: a null or empty text has no hits and gets the model's score for none; rows without a label or
doc_id are not learned from; if the sample has only one label the score is that label's share, kept inside 0.02 and
0.98. Scores depend on the text alone, so repeated rows agree. Any further columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import fold, words_of
from .store import bounded_batches, cut, drawn, free
from .units import by_bytes, tidy

#: Labelled rows that the lexicon and the model are fitted on, about.
SAMPLE_ROWS = 10_000
MOST_TERMS = 400
#: Least documents of a term, as a share of the toxic ones and as a number; least log odds ratio.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS = 0.01, 4, 2.5
STEM_LETTERS, FUZZY_LETTERS = 4, 5
#: Letters of the longest stem; whole words have no such limit.
STEM_MOST = 40
THRESHOLD = 0.7
#: Characters looked at on each side of a hit.
WINDOW = 80
KEPT_WORDS = 400_000
#: Quotation marks that open and close, and words of reporting.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
REPORTING = frozenset("said says say quote quoted quotes quoting wrote called calls reported dit écrit cité sagte schrieb zitat dijo escribió cita".split())
WORD = re.compile(r"[^\W\d_]+")


class Lexicon:
    """Terms [(text, whole word?, weight)] and the automaton over their trie."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.fuzzy: list[bool] = [False]  # whether a term that allows an edit lies below
        for t, (text, whole, _) in enumerate(terms):
            node, edits = 0, whole and len(text) >= FUZZY_LETTERS
            self.fuzzy[0] |= edits
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= edits
            self.ends[node].append(t)
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[tuple[int, int], ...]] = []
        self.stems: list[tuple[int, ...]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))
        self.seen: dict[str, tuple] = {}

    def _closed(self, states: set) -> frozenset:
        """With the letters of terms that a word may lack."""
        more = {(child, 1) for node, e in states if e == 0 and self.fuzzy[node] for child in self.children[node].values() if self.fuzzy[child]}
        best: dict[int, int] = {}
        for node, e in states | more:
            best[node] = min(e, best.get(node, 2))
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.states)
            self.states.append(states)
            self.steps.append({})
            self.accepts.append(tuple(sorted((t, e) for node, e in states for t in self.ends[node] if self.terms[t][1] and (e == 0 or len(self.terms[t][0]) >= FUZZY_LETTERS))))
            self.stems.append(tuple(t for node, e in states if e == 0 for t in self.ends[node] if not self.terms[t][1]))
        return self.ids[states]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if (child := self.children[node].get(c)) is not None:
                out.add((child, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))
                out |= {(x, 1) for x in self.children[node].values() if self.fuzzy[x]}
        got = self._state(self._closed(out)) if out else self.dead
        self.steps[state][c] = got
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term, fewest edits first; None if there is none."""
        state, steps, stem = self.start, self.steps, None
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.dead:
                return stem
            if self.stems[state]:
                stem = (self.stems[state][0], 0)
        if self.accepts[state]:
            t, e = min(self.accepts[state], key=lambda x: (x[1], x[0]))
            if e == 0 or stem is None:
                return t, e
        return stem

    def matches(self, words: list[str]) -> list:
        seen = self.seen
        if len(seen) > KEPT_WORDS:
            seen.clear()
        out = []
        for w in words:
            if w not in seen:
                seen[w] = self.match(w)
            out.append(seen[w])
        return out


def quoted(text: str, i: int, j: int) -> bool:
    """Whether text[i:j] stands in quotation marks or near a word of reporting."""
    before, after = text[max(0, i - WINDOW) : i], text[j : j + WINDOW]
    for a, b in QUOTES.items():
        if a == b:
            if before.count(a) % 2 == 1 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    near = WORD.findall(before.lower())[-6:] + WORD.findall(after.lower())[:6]
    return not REPORTING.isdisjoint(near)


#: Names of the inputs of the logistic model.
FEATURES = ("exact", "misspelled", "quoted", "share", "terms", "weight")


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """[text, feature]."""
    offsets, codes, words = words_of(texts)
    hits = lexicon.matches(words)
    hit = np.array([h is not None for h in hits], dtype=bool)
    out = np.zeros((len(texts), len(FEATURES)))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for k in np.unique(owner[hit[codes]]) if len(codes) else []:
        text = texts[int(k)].as_py()
        exact = fuzzy = said = 0
        terms: set = set()
        n = 0
        for m in WORD.finditer(text):
            n += 1
            found = lexicon.match(w) if (w := m[0].lower()) not in lexicon.seen else lexicon.seen[w]
            if found is None:
                continue
            if quoted(text, m.start(), m.end()):
                said += 1
            elif found[1]:
                fuzzy += 1
                terms.add(found[0])
            else:
                exact += 1
                terms.add(found[0])
        out[k] = np.log1p(exact), np.log1p(fuzzy), np.log1p(said), 10 * (exact + fuzzy) / max(n, 10), np.log1p(len(terms)), max([lexicon.terms[t][2] for t in terms], default=0.0)
    return out


def _terms(counts: list, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """From (term, in toxic, in clean), best first: terms far commoner in toxic documents, none a prefix of another."""
    scored = []
    for term, a, b in counts:
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        if odds >= LEAST_ODDS:
            scored.append((round(a * odds, 6), len(term), term, float(odds)))
    out: list[tuple[str, bool, float]] = []
    taken: list[str] = []
    for _, _, term, odds in sorted(scored, key=lambda x: (-x[0], -x[1], x[2])):
        bare = term.removesuffix("$")
        if any(bare.startswith(t) or t.startswith(bare) for t in taken):
            continue
        taken.append(bare)
        out.append((bare, term.endswith("$"), odds))
        if len(out) >= MOST_TERMS:
            break
    # a stem hides its own word, which still takes misspellings
    words = {term.removesuffix("$"): odds for _, _, term, odds in scored if term.endswith("$")}
    return out + [(bare, True, words[bare]) for bare, whole, _ in out if not whole and len(bare) >= FUZZY_LETTERS and bare in words]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with an L2 penalty on the weights."""
    w = np.zeros(x.shape[1] + 1)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame) -> dict:
    """A model from rows of text, toxic (0 or 1), at most a bounded sample: they are counted in Spark, and the driver gets the best terms and one row of inputs for each."""

    @tidy
    def count(batches):
        both = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for part in by_bytes(batch, "text"):
                offsets, codes, words = words_of(part.column("text"))
                forms = [[*(w[:i] for i in range(STEM_LETTERS, min(len(w), STEM_MOST) + 1)), *([w + "$"] if len(w) >= 3 else [])] for w in words]
                for y, i, j in zip(part.column("toxic").to_pylist(), offsets[:-1], offsets[1:]):
                    rows[y] += 1
                    both[y].update({f for k in set(codes[i:j].tolist()) for f in forms[k]})
        terms = list(both[0] | both[1])
        for i in range(0, len(terms), 50_000):
            own = terms[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(own, pa.string()), "toxic": pa.array([both[1][t] for t in own], pa.int64()), "clean": pa.array([both[0][t] for t in own], pa.int64())})
        yield pa.RecordBatch.from_pydict({"term": pa.array([""]), "toxic": pa.array([rows[1]]), "clean": pa.array([rows[0]])})

    bounded_batches(labelled.sparkSession)
    labelled = cut(labelled)
    counted = cut(labelled.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter((F.col("toxic") >= LEAST_DOCS) | (F.col("term") == "")))
    total = counted.filter("term = ''").first()
    toxic, clean = (total["toxic"], total["clean"]) if total else (0, 0)
    if not toxic or not clean:
        return {"terms": [], "w": np.zeros(len(FEATURES)), "b": float(np.log(49.0) * (bool(toxic) - bool(clean)))}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = counted.filter((F.col("term") != "") & (F.col("toxic") >= LEAST_SHARE * toxic) & (odds >= LEAST_ODDS)).orderBy((-F.col("toxic") * odds), "term").limit(20 * MOST_TERMS)
    terms = _terms([(r["term"], r["toxic"], r["clean"]) for r in best.collect()], toxic, clean)  # a bounded number

    @tidy
    def inputs(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                x = features(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(x.shape[1])] + [part.column("toxic").cast(pa.int32())], names=[*FEATURES, "y"])

    rows = labelled.mapInArrow(inputs, ", ".join(f"{n} double" for n in FEATURES) + ", y int").toPandas().sort_values([*FEATURES, "y"])  # SAMPLE_ROWS, about
    w, b = _logistic(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(dtype=float))
    return {"terms": terms, "w": w, "b": b}


def with_score(docs: DataFrame, model: dict, at: str = "_toxicity") -> DataFrame:
    """docs with the score, a double, as the last column ``at``, or a longer name where docs has one of that name."""
    bounded_batches(docs.sparkSession)
    at = free(docs, at)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        lexicon = Lexicon(own["terms"])
        for texts in batches:
            parts = [features(x.column(0), lexicon) for x in by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
            x = np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ own["w"] + own["b"], -30, 30))))

    return docs.withColumn(at, score(F.col("text")))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of about sample_rows labelled documents outside the held-out fold, drawn by a hash of doc_id."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = drawn(labels, sample_rows, labels.count(), "toxicity", "doc_id").dropDuplicates(["doc_id", "toxic"])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = with_score(docs, model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
