"""Phrase mining, fill-in-middle and repeated passages against plain loops, on odd rows, ties, long texts and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskara.llm import collocations, fim, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\t ", "a", " a", "a ", "  a  b\x0b\x0cc \r\n", "é ü x  ñ 日本語 テキスト 😀", "has <S> mark", "<P>", "x" * 9000, " ".join(f"wörd{i}" for i in range(4000)), "  \t" * 3000 + "end", "a  " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Each odd text under twelve ids, a repeated row, a null doc_id, clashing further columns."""
    rows = [(100 * k + i, t, "en", "s", 0) for k in range(12) for i, t in enumerate(ODD)] + [(4, "a", "en", "s", 0), (None, "null id here", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("_fim", F.lit(1)).withColumn("fim", F.lit("x")).withColumn("th", F.lit(2)).withColumn("_th", F.lit(3))


def middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}") if h4 % 100 < 80 else (n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}")


def test_fill_in_middle(spark, odd):
    out = fim.fill_in_middle(odd, "out")
    assert out.columns == [*odd.columns, "out"]
    rows = out.withColumn("back", fim.restored(F.col("out.output"), F.col("out.form"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r["out"]) == middle(r["doc_id"], r["text"]), r
        assert r["back"] == (r["text"] or "")
    assert {r["out"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(odd.limit(0), "out").count() == 0


def test_chunks():
    """Cuts of every rank, whatever chunks and blocks hold them."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab \té日"), n)) for n in (0, 1, 7, 300, 5000)]
    was = fim.CHUNK, fim.BLOCK
    try:
        for fim.CHUNK, fim.BLOCK in ((3, 8), (64, 64), (4096, 1 << 20)):
            data = [t.encode() for t in texts]
            chunks = fim.Chunks(np.frombuffer(b"".join(data), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
            for i, t in enumerate(texts):
                units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
                assert chunks.tokens[i] == len(units)
                ends = np.append(0, np.cumsum([len(u) for u in units]))
                assert (chunks.cuts(np.full(len(ends), i), np.arange(len(ends))) == ends).all()
    finally:
        fim.CHUNK, fim.BLOCK = was


def mined(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= least}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and not 100 * inside[p] >= 80 * a:
                score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_phrases(spark):
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "ÉTÉ", "d d", "x1", "rare-a", "日本"]
    texts = [" ".join(rng.choice(words, 40, p=[0.3, 0.25, 0.15, 0.1, 0.1, 0.02, 0.08])).replace("x1 ", str(rng.choice(["x1, ", "x1\n", "x1\t", "x1.  "]))) for _ in range(120)]
    rows = [(i, t, [None, "en", "de"][i % 3], "s", 0) for i, t in enumerate(texts)]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(["", None, " ", "...", "w" * 6000, "solo", "again and again " * 900])] + [rows[0], (None, "null null null", "en", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("word", F.lit("w"))
    want = mined([(r[1], r[2]) for r in rows], 8, 25)
    assert {len(p.split()) for _, _, p, *_ in want} >= {2, 3} and len({r[0] for r in want}) == 3
    tight = collocations.Sizes(1 << 20, 3, 500, 16)
    # ids of a dictionary, and hashes; a bitmap that rules nothing out
    for most_words, sizes in ((collocations.MOST_WORDS, tight), (0, tight), (collocations.MOST_WORDS, collocations.Sizes(bits=64))):
        assert sorted(tuple(r) for r in collocations.phrases(docs, 8, 25, most_words, sizes).collect()) == want
    assert collocations.phrases(docs.limit(0)).count() == 0 == collocations.phrases(docs.filter("doc_id = 1")).count()


def test_summed_runs_over_batches():
    key = [b"\0\1", b"\0\1", b"\0\2", b"\0\2", b"\0\2", b"\1\0"]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:j], pa.binary()), pa.array([3] * (j - i))], names=["key", "c"]) for i, j in ((0, 1), (1, 1), (1, 3), (3, 4), (4, 6))]
    got = [r for b in collocations._summed(batches, 4) for r in b.to_pylist()]
    assert got == [{"key": b"\0\1", "a": 6}, {"key": b"\0\2", "a": 9}]


def unrepeated(rows):
    """n_bytes, n_removed, n_spans, what is left of every text."""
    data = [(t or "").encode() for t in rows]
    size = repeats.LENGTH
    seen = Counter(x[i : i + size] for x in data for i in range(len(x) - size + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, dtype=np.int64)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        out.append((len(x), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), bytes(np.frombuffer(x, dtype=np.uint8)[~gone])))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    shared = [text(n) for n in (330, 352, 400, 401, 450, 700, 1500)]
    rows = [text(200) + p[: int(rng.integers(len(p) // 2, len(p) + 1))] + text(150) for p in shared for _ in range(6)]
    rows += [text(90) + p + text(90) for p in shared for _ in range(3)] + shared[4:5] * 3
    near = text(3000)
    rows += [near[:k] + "#" + near[k + 1 :] for k in rng.integers(0, 3000, 8)]
    both = text(500)
    rows += [both + text(300) + both, both[50:] + both[:450]]
    return rows + ["", None, "short", "=" * 3000, "ab" * 1000 + text(10), "line that stands often\n" * 100, "=" * 400, "=" * 399, "x" + "=" * 400]


@pytest.mark.parametrize("size", [repeats.SLICE, 700])
def test_repeats(spark, passages, size):
    """Also where every text goes through in slices."""
    rows = [(None if i == 3 else i, t, "en", "s", 0) for i, t in enumerate(passages)] + [(None, "null id " * 80, "en", "s", 0), (0, passages[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_th", F.lit(1)).withColumn("th", F.lit("t")).withColumn("m", F.lit(0)).repartition(5)
    out = repeats.remove_repeats(docs, "out", size)
    assert out.columns == [*docs.columns, "out"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"], *r["out"]) for r in out.collect()), key=key)
    want = sorted(((r[0], r[1], *w) for r, w in zip(rows, unrepeated([r[1] for r in rows]))), key=key)
    assert [(*g[:5], bytes(g[5])) for g in got] == want
    assert any(0 < g[3] < g[2] for g in got) and any(g[4] > 1 for g in got)


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(empty, "out").count() == 0
    one = repeats.remove_repeats(spark.createDataFrame([(1, "abc" * 10, "en", "s", 0)], DOCS), "out").first()["out"]
    assert (one["n_bytes"], one["n_removed"], one["n_spans"], bytes(one["kept"])) == (30, 0, 0, b"abc" * 10)


def test_queries(spark):
    assert repeats.op13(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for op, sql in ((collocations.op11, collocations.ORACLE_SQL), (fim.op12, fim.ORACLE_SQL)):
        df = op(spark, SF)
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_planted_passages(spark):
    """Passages in two documents go where they have LENGTH bytes, shorter ones stay, however many words they have; so do documents without one."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(n))
    passages = {i: words(51 + 3 * i) for i in range(20)}
    rows = [(2 * i + k, f"{words(150)} {p} {words(150)}") for i, p in passages.items() for k in (0, 1)] + [(1000 + i, words(300)) for i in range(20)]
    removed = dict(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "out").select("doc_id", "out.n_removed").collect())
    assert removed == _removed(rows) and len({v > 0 for v in removed.values()}) == 2 and all(removed[1000 + i] == 0 for i in range(20))


def _removed(rows):
    seen = Counter(t[i : i + repeats.LENGTH] for _, t in rows for i in range(len(t) - repeats.LENGTH + 1))
    return {d: len({j for i in range(len(t) - repeats.LENGTH + 1) if seen[t[i : i + repeats.LENGTH]] > 1 for j in range(i, i + repeats.LENGTH)}) for d, t in rows}
