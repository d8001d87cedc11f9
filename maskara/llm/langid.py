"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary carry, in each language, a probability. A word's probability in a language
is the sum over all its segmentations into pieces, by a forward pass over its letters; a text's is the product over
its words. The probabilities are fitted by a few rounds of expectation-maximisation (forward and backward passes
give each piece's expected count over all segmentations) on the words of a bounded sample of labelled rows of each language.

Words are maximal runs of letters, in lower case, with a mark for their start, of whatever length: beyond
``MOST_LETTERS`` the forward pass is scaled as it goes, so that nothing underflows. Only for learning is a longer word cut
into parts of that length, of which the first alone has the mark. A letter outside the vocabulary has a small fixed probability
in every language. Each distinct word is scored once a worker, as long as its table of ``CACHED_WORDS`` has room; the table
outlives a task and goes when another operator's task starts.

Nulls and odd rows: a null text, or one without a letter, is ``und`` with score 0, and so is every text if no row
could be learned from; a null doc_id is learned from like others, if lang is not null. Ties go to the smallest
language name. Repeated rows get equal results. Any further columns pass through.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import bounded_batches, cut, free
from .units import Cut, Places, by_bytes, kept, tidy

#: The model is fitted on about so many labelled rows of each language, drawn by a hash of doc_id.
SAMPLE_ROWS = 1500
ROUNDS = 3
MOST_LETTERS = 24
#: Probability of a letter outside the vocabulary; weight of the distribution over all languages in each one's.
UNKNOWN, SHARED = 1e-7, 0.02
CACHED_WORDS = 360_000
#: Bytes of text looked at at a time.
SLICE_BYTES = 1_000_000
UNDETERMINED = "und"
#: Below this posterior a document is rejected by the pipeline.
MIN_SCORE = 0.5
START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that consist of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.vocab_size()))
    return sorted({p for p in pieces if p.removeprefix(START).isalpha() or p == START})


def bare(texts: pa.Array) -> pa.Array:
    """Lower case, with a space for each run of other characters than letters."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"\PL+", " ")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts -> (offsets by text, codes, distinct words); the word "" stands between runs and counts for nothing."""
    lists = pc.split_pattern(bare(texts), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class Lattice:
    """All segmentations of words into pieces, in batches of similar length. Words have their START mark, if any, before them."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        # for every beginning of a piece its number, or none
        self.begins = {p[:k]: self.none for p in pieces for k in range(1, len(p))} | self.ids

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and the piece from letter i that is k + 1 long as [word, i, k]."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        out = np.full((len(words), width, min(self.longest, width)), self.none, dtype=np.int32)
        get, none = self.begins.get, self.none
        for w, row in zip(words, out):
            n = len(w)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    if (found := get(w[i:j])) is None:
                        break
                    if found != none:
                        row[i, j - i - 1] = found
        one = out[:, :, 0]
        one[(one == none) & (np.arange(width) < sizes[:, None])] = self.unknown
        return sizes, out

    @staticmethod
    def forward(arcs: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[word, letters covered, language]: probability summed over segmentations of that prefix."""
        n, width, longest = arcs.shape
        a = np.zeros((width + 1, n, p.shape[1]))
        a[0] = 1
        for j in range(1, width + 1):
            for k in range(min(longest, j)):
                a[j] += a[j - k - 1] * p[arcs[:, j - k - 1, k]]
        return a

    @staticmethod
    def backward(sizes: np.ndarray, arcs: np.ndarray, p: np.ndarray) -> np.ndarray:
        n, width, longest = arcs.shape
        b = np.zeros((width + 1, n, p.shape[1]))
        b[sizes, np.arange(n)] = 1
        for i in range(width - 1, -1, -1):
            for k in range(min(longest, width - i)):
                b[i] += p[arcs[:, i, k]] * b[i + k + 1]
        return b

    def batches(self, words: list[str], most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Indices, lengths and arcs."""
        order = np.argsort([len(w) for w in words], kind="stable")
        for i in range(0, len(order), most):
            at = order[i : i + most]
            yield at, *self.arcs([words[k] for k in at])

    def scaled(self, word: str, p: np.ndarray) -> np.ndarray:
        """The log probability of a word of any length in each language: forward, with what is summed so far kept near 1."""
        window, log = [np.ones(p.shape[1])], np.zeros(p.shape[1])  # of the last letters, the latest first
        for j in range(1, len(word) + 1):
            total = np.zeros(p.shape[1])
            for k, a in enumerate(window):
                found = self.ids.get(word[j - k - 1 : j], self.unknown if k == 0 else self.none)
                if found != self.none:
                    total += a * p[found]
            window = [total, *window[: self.longest - 1]]
            most = np.maximum(np.max(window, axis=0), 1e-300)
            window = [a / most for a in window]
            log += np.log(most)
        return log + np.log(np.maximum(window[0], 1e-300))

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]."""
        out = np.zeros((len(words), p.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= MOST_LETTERS + 1]
        for at, sizes, arcs in self.batches([words[i] for i in short]):
            out[[short[i] for i in at.tolist()]] = np.log(np.maximum(self.forward(arcs, p)[sizes, np.arange(len(at))], 1e-300))
        for i, w in enumerate(words):
            if len(w) > MOST_LETTERS + 1:
                out[i] = self.scaled(w, p)
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of every piece over the segmentations of the words, for one language's p[:, 1]."""
        total = np.zeros(len(self.ids) + 2)
        for at, sizes, arcs in self.batches(words):
            a, b = self.forward(arcs, p)[:, :, 0], self.backward(sizes, arcs, p)[:, :, 0]
            whole = np.maximum(b[0], 1e-300)
            for i in range(arcs.shape[1]):
                for k in range(min(arcs.shape[2], arcs.shape[1] - i)):
                    ids = arcs[:, i, k]
                    total += np.bincount(ids, a[i] * p[ids, 0] * b[i + k + 1] / whole * counts[at], minlength=len(total))
        return total[: len(self.ids)]


def _with_extra(p: np.ndarray) -> np.ndarray:
    """Rows for an unknown letter and for no piece."""
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def _parts(word: str) -> list[str]:
    """What is learned from a word."""
    word = START + word
    return [word[: MOST_LETTERS + 1], *(word[i : i + MOST_LETTERS] for i in range(MOST_LETTERS + 1, len(word), MOST_LETTERS))]


def fit(labelled: DataFrame, vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from rows of doc_id, text, lang (lang not null): pieces, languages, p[piece, language], prior."""
    pieces = read_pieces(vocabulary or default_vocabulary())
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    shares = spark.createDataFrame([(lang, max(1, math.ceil(min(1.0, sample_rows / n) * (1 << 50)))) for lang, n in rows.items()], "lang string, upto long")
    drawn = labelled.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 50)) < F.col("upto")).select("lang", "text")

    @tidy
    def count_words(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for piece in by_bytes(batch, "text"):
                offsets, codes, words = words_of(piece.column("text"))
                for lang, i, j in zip(piece.column("lang").to_pylist(), offsets[:-1], offsets[1:]):
                    at, each = np.unique(codes[i:j], return_counts=True)
                    own = found.setdefault(lang, Counter())
                    for k, c in zip(at.tolist(), each.tolist()):
                        if words[k]:
                            for part in _parts(words[k]):
                                own[part] += c
        for lang, own in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "word": list(own), "n": list(own.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = cut(drawn.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(rows)
    p = np.full((len(pieces), max(len(langs), 1)), 1.0 / len(pieces))
    model = {"pieces": pieces, "langs": langs, "p": p, "prior": np.log(np.array([rows[x] for x in langs]) / max(sum(rows.values()), 1)) if langs else np.zeros(0)}
    if not langs:
        return model
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pieces, langs, p))

        @tidy
        def expect(batches):
            own_pieces, own_langs, own_p = shared.value
            lattice, padded, total = Lattice(own_pieces), _with_extra(own_p), np.zeros(own_p.shape)
            for batch in batches:
                lang, word, n = batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for k, name in enumerate(own_langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    if at:
                        total[:, k] += lattice.expected([word[i] for i in at], n[at].astype(float), padded[:, k : k + 1])
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(i, pa.int32()), "k": pa.array(k, pa.int32()), "c": total[i, k]})

        got = words.mapInArrow(expect, "piece int, k int, c double").groupBy("piece", "k").agg(F.sum("c").alias("c")).toPandas()  # at most pieces x languages
        counts = np.zeros(p.shape)
        counts[got["piece"], got["k"]] = got["c"]
        each = (counts + 1e-3) / (counts + 1e-3).sum(0)
        whole = (counts.sum(1) + 0.1) / (counts.sum(1) + 0.1).sum()
        p = (1 - SHARED) * each + SHARED * whole[:, None]
        shared.unpersist()
    return model | {"p": p}


class _Scorer:
    """Scores texts; keeps the log probabilities of distinct words."""

    def __init__(self, model: dict):
        self.model, self.lattice, self.p = model, Lattice(model["pieces"]), _with_extra(model["p"])
        self.seen = Places(1 << 14)
        self.rows = np.zeros((1 << 14, len(model["langs"])))

    def table(self, words: Cut) -> np.ndarray:
        """The number in self.rows of each word."""
        if self.seen.n > CACHED_WORDS:
            self.seen.clear()
        first = self.seen.n
        got, new = self.seen.numbers(words.hashes())
        if len(new):
            need = first + len(new)
            if need > len(self.rows):
                self.rows = np.vstack([self.rows[:first], np.zeros((max(need, len(self.rows) * 3 // 2) - first, self.rows.shape[1]))])
            self.rows[first:need] = self.lattice.log_probabilities([START + w for w in words.strings(new)], self.p)
        return got

    def scored(self, texts: pa.Array) -> pa.StructArray:
        langs = self.model["langs"]
        n = len(texts)
        if not langs:
            return pa.StructArray.from_arrays([pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))], ["lang_pred", "score"])
        words = Cut.runs(bare(texts))
        table = self.table(words)
        each = np.diff(words.offsets)
        owner = np.repeat(np.arange(n), each)
        total = np.stack([np.bincount(owner, self.rows[table, k], minlength=n) for k in range(len(langs))], axis=1) + self.model["prior"]
        best = total.argmax(1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(1)
        names = [langs[b] if s else UNDETERMINED for b, s in zip(best, each)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(each > 0, score, 0.0))], ["lang_pred", "score"])


def with_language(docs: DataFrame, model: dict, at: str = "_language") -> DataFrame:
    """docs with, as the last column, a struct ``at`` (or a longer name where docs has one of that name) of lang_pred and score.

    The model is at most vocabulary x languages numbers.
    """
    bounded_batches(docs.sparkSession)
    at = free(docs, at)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept("langid", name, lambda: _Scorer(shared.value))
        for texts in batches:
            parts = [scorer.scored(x.column(0)) for x in by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES)]
            yield pa.concat_arrays(parts) if parts else scorer.scored(texts)

    return docs.withColumn(at, predict(F.col("text")))


def fold(doc_id, folds: int):
    """crc32 of doc_id as text, modulo folds; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds


def fit_documents(docs: DataFrame, **how) -> dict:
    """The model from the labelled documents outside the held-out fold."""
    return fit(docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), **how)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scored = with_language(docs.select("doc_id", "text"), fit_documents(docs))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "_language.lang_pred", "_language.score")
