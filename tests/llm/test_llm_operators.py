"""The training-data operators against brute force, and on nulls, empty and odd rows, ties and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskara.llm import bpe, embed_dedup, graph, hilbert_ann, langid, license_scan, line_dedup, mixing, shingles, simhash, token_store, toxicity, units

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "  ", "a  b", "a \nb", "\n\n x", "a\n \nb", "x<|endoftext|>y", "a <|endoftext|> b", "it's we'll 'S", "naïve café x  y", "a\x1cb \x1c c", "a\x85b \x85 c", "日本語 テキスト 😀 👩‍👩‍👧", "tab\t\tx \t y", "   lead", "trail   ", "\r\n\r\n a\r\n", "12345 67 8½ ²", "Ġx Ġ", "é ́x", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null doc_id, clashing further columns."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(0, "", "en", "s", 0), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("_new", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("_language", F.lit(2))


def test_units():
    import pyarrow as pa
    import tokenizers

    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    odd = ODD + [f"a{x} b {x}c{x}{x} d\n {x}" for x in white] + [f" {x}lead" for x in white]
    cut = units.Cut.of(pa.array([None, *odd]).slice(1))
    texts = cut.strings(np.arange(len(cut)))
    encoder = bpe.UnitEncoder(open(bpe.default_tokenizer(), encoding="utf-8").read())
    lengths, ids = encoder(cut, np.arange(len(cut)))
    ids = np.split(ids, np.cumsum(lengths)[:-1])
    for i, x in enumerate(odd):
        parts = slice(cut.offsets[i], cut.offsets[i + 1])
        assert "".join(texts[parts]) == (x or "")
        assert [int(k) for p in ids[parts] for k in p] == t.encode(x or "", add_special_tokens=False).ids, x
    # hashes tell the same units apart as their texts do, also end to end, and so does the table
    h = cut.hashes()
    assert len({tuple(x) for x in h.tolist()}) == len(set(texts))
    again = units.Cut.end_to_end(cut.bytes_of(np.arange(len(cut))).tobytes(), cut.ends - cut.starts)
    assert (again.hashes() == h).all() and again.strings(np.arange(len(cut))) == texts
    table = units.Places(2)
    numbers, new = table.numbers(h)
    assert len(new) == table.n == len(set(texts)) and (table.numbers(h)[0] == numbers).all()
    assert len({(n, x) for n, x in zip(numbers.tolist(), texts)}) == table.n


def test_bpe(spark, odd):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(bpe.encode(odd)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] is not None, r["doc_id"] or 0, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encode(odd.filter("doc_id > 0"))).collect()} == {i: t or "" for i, t in enumerate(ODD) if i}
    assert bpe.round_trip(bpe.encode(odd.limit(0))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 5), (2000, 10), (2000, 10**9), (900, 2**62), (700, 700)):
        v = np.sort(rng.integers(-u, u, n))
        f, _ = token_store.EliasFano.read(memoryview(token_store.EliasFano.of(v).to_bytes()), 0)
        assert (f.all() == v).all() and all(f.select(i) == v[i] for i in range(0, n, 13))
        if n > 500 and u == 10**9:
            assert len(f.low) + len(f.high) < 8 * n / 2
    with pytest.raises(IndexError):
        token_store.EliasFano.of(np.arange(3)).select(3)


def test_token_store(spark, odd, tmp_path, monkeypatch):
    import tokenizers

    monkeypatch.setattr(token_store, "SHARD_DOCS", 5)
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    token_store.write(odd, str(tmp_path / "t"))
    files = token_store.read(spark, str(tmp_path / "t"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.documents(files).collect())
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, at = [], 0
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((at, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    (tmp_path / "f").mkdir()
    token_store.export(files, str(tmp_path / "f")).collect()
    one = token_store.TokenFile(sorted((tmp_path / "f").glob("*.eft"))[0].read_bytes())
    assert one.document(0).tolist() == [*t.encode("null id", add_special_tokens=False).ids, 2] and one.doc_ids()[0] is None
    token_store.write(odd.limit(0), str(tmp_path / "e"))
    assert token_store.documents(token_store.read(spark, str(tmp_path / "e"))).count() == 0


def reference_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bk_tree():
    rng = np.random.default_rng(4)
    v = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]))
    tree = simhash.Tree(v)
    got = {(int(q), int(n)) for a, b in tree.within(v, 2) for q, n in zip(a, b)}
    assert got == {(i, j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2).tolist()}


def test_simhash(spark, odd, monkeypatch):
    assert all(simhash.fingerprint(t) == reference_fingerprint(t) for t in ODD)
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = np.random.default_rng(7)
    centers = rng.integers(-(2**63), 2**63, 12)
    fps = {int(c) for c in centers} | {int(c ^ (1 << int(rng.integers(0, 62)))) for c in centers for _ in range(9)}
    found = graph.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {r["node"]: r["root"] for r in found.collect()}
    v = np.array(sorted(fps))
    root = {int(x): int(x) for x in v}
    for _ in range(len(v)):
        new = {int(x): min(root[int(y)] for y in v[np.bitwise_count(v ^ x) <= 2]) for x in v}
        if new == root:
            break
        root = new
    assert got == {k: r for k, r in root.items() if r != k or any(q != k and s == k for q, s in root.items())}
    out = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 0)} <= out and (None, None) in out
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (1, 2, 3)").count() == 0
    # one row of each group, whatever shares its doc_id
    t, u = "one text of some words for all", "quite another text, long enough to differ in many bits of it"
    rows = spark.createDataFrame([(9, t), (9, t), (3, u), (5, u), (5, t), (None, u), (None, "alone"), (None, "alone"), (4, "repeated"), (4, "repeated")], "doc_id long, text string")
    for keep in (simhash.keep_one, shingles.keep_one):
        assert sorted((r["doc_id"] or 0, r["text"]) for r in keep(rows).collect()) == [(0, "alone"), (3, u), (4, "repeated"), (5, t)], keep
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    rows = [(i, f"shared line of boilerplate text\nown {i}\r\nshort\n", "en", f"s{i}", 0) for i in range(5)] + [(9, "in three sites only, not in four\nx", "en", f"s{i}", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for limit in (100, 0):
        got = {r["doc_id"]: (r["text"], r["_removed"]) for r in line_dedup.drop_boilerplate(docs.filter("n_chars = 0 AND (lang = 'en') AND source <> 's'"), broadcast_rows=limit).collect()}
        assert got[0] == (rows[0][1], 0) and got[3] == ("own 3\r\n", 2) and got[9][1] == 0
    # large ids beside none: the line stays in the first document, whatever its id
    big = [(2**53 + 1 + i, f"a line of many sites\nown {i}", "en", f"s{i}", 0) for i in range(5)] + [(None, "another line\nin none", "en", "s0", 0)] + [(7 + i, f"another line\n{i}", "en", f"s{i}", 0) for i in range(5)]
    for limit in (100, 0):
        got = line_dedup.drop_boilerplate(spark.createDataFrame(big, DOCS), broadcast_rows=limit).collect()
        assert sorted(r["text"] for r in got) == sorted(["a line of many sites\nown 0", *(f"own {i}" for i in range(1, 5)), "another line\nin none", *map(str, range(5))])
    odd = odd.withColumn("_removed", F.lit("given"))
    out = line_dedup.drop_boilerplate(odd)
    assert out.select("_removed").distinct().count() == 1 and out.columns[-1] == "_removed_"
    assert set(odd.columns) <= set(out.columns) and out.count() == odd.count() and line_dedup.drop_boilerplate(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    sizes = [("b", 100), ("a", 10), ("c", 1000), (None, 50)]
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes], "source string, n_docs long, source_size long")
    total, weights, caps = 1.5 * 1160, dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), {s: 2 * n for s, n in sizes}
    want, free = {}, set(caps)
    while True:
        left = total - sum(want.values())
        share = {s: weights[s] * left / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= caps[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = caps[s]
            free.remove(s)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in got)
    # the same with so few ratios held at a time that ranges are cut again
    many = [(f"s{i:03}", 1, (i * 7919) % 997 + 1) for i in range(300)]
    weighed = [(2 * n / [5, 2, 1][i % 3], 2 * n, [5, 2, 1][i % 3]) for i, (_, _, n) in enumerate(many)]
    left, weights = 1.5 * sum(n for *_, n in many), sum(w for *_, w in weighed)
    for ratio, cap, w in sorted(weighed):
        if w * left / weights >= cap:
            left, weights = left - cap, weights - w
    table = spark.createDataFrame(weighed, "ratio double, cap long, weight int")
    assert mixing.level(table, 1.5 * sum(n for *_, n in many), 4, 5) == mixing.level(table, 1.5 * sum(n for *_, n in many)) == (left, weights)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "xyz"[i % 3], 0) for i in range(3000)], DOCS)
    made = mixing.plan(mixing.measured(docs))
    rows = mixing.with_copies(mixing.measured(docs), made).groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("taken"), F.max("_copies").alias("most"), F.first("_target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 7 and r["most"] <= 2 for r in rows)
    # probabilities are unequal: of a source that is sampled, longer documents come more often
    each = mixing.with_copies(mixing.measured(docs), made).join(made.select("source", "copies", "p"), "source").filter("p BETWEEN 0.2 AND 0.8").groupBy((F.col("size") > 4).alias("long")).agg(F.avg(F.col("_copies") - F.col("copies")).alias("p")).collect()
    assert {r["long"] for r in each} == {True, False} and dict((r["long"], r["p"]) for r in each)[True] > dict((r["long"], r["p"]) for r in each)[False] + 0.05
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.filter("text IS NULL OR trim(text) = ''").count() == 0 and mixing.mix(odd.limit(0)).count() == 0
    assert [r[0] for r in odd.select(mixing.n_words(F.col("text"))).collect()] == [len(WORD.findall(r["text"] or "")) for r in odd.select("text").collect()]


def test_language(spark, odd):
    text = {"en": "the cat and the dog were in the house with other things", "de": "der hund und die katze waren nicht in dem haus mit anderen", "fr": "le chat et le chien étaient dans la maison avec les autres"}
    docs = spark.createDataFrame([(i, text[x], x, "s", 0) for i in range(40) for x in [("en", "de", "fr")[i % 3]]], DOCS)
    model = langid.fit_documents(docs)
    out = langid.with_language(docs, model, "p").select("lang", "p.*").collect()
    assert all(r["lang"] == r["lang_pred"] and 0.9 < r["score"] <= 1 for r in out)
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.with_language(odd, model, "p").select("text", "p.*").collect()}
    assert got[None] == got[""] == got["12345 67 8½ ²"] == ("und", 0.0) and got["日本語 テキスト 😀 👩‍👩‍👧"][0] != "und"
    none = langid.fit_documents(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.with_language(docs, none, "p").select("p.*").collect()} == {"und"}


def test_lattice():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    lattice, p = langid.Lattice(pieces), np.linspace(0.05, 0.2, 7)[:, None]

    def every(w):
        """The sum over all segmentations, by recursion."""
        return 1.0 if not w else sum(p[pieces.index(w[:k])][0] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    words = ["a", "ab", "abab", "baab", "ababababab", "ab" * 9, "abba" * 6 + "a"]
    got = lattice.log_probabilities(["▁" + w for w in words], langid._with_extra(p))[:, 0]
    assert np.allclose(np.exp(got), [every("▁" + w) for w in words])
    # a word of any length, in one go: the same as scaled, and no underflow
    assert np.allclose([lattice.scaled("▁" + w, langid._with_extra(p))[0] for w in words], got)
    long = [lattice.log_probabilities(["▁" + "ab" * n], langid._with_extra(p))[0, 0] for n in (100, 2000, 3900)]
    assert np.allclose((long[2] - long[1]) / 1900, (long[1] - long[0]) / 1900) and long[2] < -800
    counts = lattice.expected(["▁ab"], np.array([1.0]), langid._with_extra(p))
    assert np.isclose(counts @ np.array([len(x) for x in pieces]), 3)  # letters covered, the mark included


def test_levenshtein():
    from itertools import product

    def distance(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            d = _row(d, x, b, i)
        return int(d[-1])

    def _row(d, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
        return np.array(out)

    terms = [("abcde", True, 1.0), ("abxye", True, 1.0), ("abc", True, 1.0), ("zzzz", False, 1.0)]
    lexicon = toxicity.Lexicon(terms)
    words = {"".join(w) for n in range(2, 7) for w in product("abcz", repeat=n)} | {"abcde", "abcdde", "bcde", "xabcde", "abxyee", "abye", "zzzzabc", "azzzz"}
    for w in words:
        found = lexicon.match(w)
        exact = [t for t, (x, whole, _) in enumerate(terms) if (w == x if whole else w.startswith(x))]
        near = [t for t, (x, whole, _) in enumerate(terms) if whole and len(x) >= 5 and distance(w, x) <= 1]
        assert (found is None) == (not exact and not near), w
        if found and exact:
            assert found[1] == 0, w


def test_toxicity(spark, odd):
    assert toxicity.quoted('he said "you idiot" to me', 13, 18) and not toxicity.quoted("you idiot are here", 4, 9)
    docs = spark.createDataFrame([(i, ("such a stupido thing " if i % 4 == 0 else "such a lovely thing ") + "more words " * 5, None, None, None) for i in range(400)], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert any(t[0].startswith("stup") for t in model["terms"])
    out = {r["text"]: r["s"] for r in toxicity.with_score(odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1, "a stupidi thing"), (2, "so stupido")], "doc_id long, text string")), model, "s").collect()}
    assert out["so stupido"] > 0.7 > out[""] == out[None] and all(0 <= s <= 1 for s in out.values())
    assert toxicity.fit(toxicity.training_rows(docs, labels.limit(0)))["terms"] == []


@pytest.mark.parametrize("few", [2048, 0])
def test_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(embed_dedup, "FEW", few)  # with and without an index
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    v = np.vstack([base, base[:8] + 0.05 * rng.normal(size=(8, 16)), base[:1]]).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)]
    bad = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0, None] + [0.0] * 14, 0), (104, v[0].tolist(), None), (105, [1.0], 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.93) & ((np.arange(len(v)) % 2)[:, None] == (np.arange(len(v)) % 2)[None])
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(bad) and [got[i]["n_links"] for i in range(len(v))] == link.sum(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (100, 101, 102, 103, 104, 105)) and not got[None]["kept"]
    root = list(range(len(v)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(v))]
    assert [got[i]["component_id"] for i in range(len(v))] == root
    found = hilbert_ann.search(df, every=5).collect()
    taking = {**{i: v[i].astype(float) for i in range(len(v))}, 104: v[0].astype(float)}
    hit = total = 0
    for q in (i for i in taking if i % 5 == 0):
        want = sorted((float(np.sqrt(((taking[q] - x) ** 2).sum())), i) for i, x in taking.items() if i != q)[:10]
        own = [r for r in found if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: r["rank"])] == list(range(1, 11))
        x = {i: d for d, i in sorted((float(np.sqrt(((taking[q] - y) ** 2).sum())), i) for i, y in taking.items() if i != q)}
        assert all(np.isclose(r["score"], x[r["vec_id"]], rtol=1e-15) for r in own)
        hit, total = hit + len({i for _, i in want} & {r["vec_id"] for r in own}), total + 10
    assert hit >= 0.9 * total
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0 and hilbert_ann.search(df.limit(0)).count() == 0


def test_odd_vectors(spark, monkeypatch):
    """Against brute force: vec_ids with several vectors, repeated rows, two lengths; links counted once, results full, scores exact."""
    rng = np.random.default_rng(1)
    rows = [(0, [float(x) for x in 0.01 * rng.normal(size=4) + 1], "a") for _ in range(14)] + [(i, [float(x) for x in rng.normal(size=4) + 1], "a") for i in range(1, 30)]
    rows += [(1, [3.0, 1.0, 0.0, 0.5], "a")] * 2 + [(2, [3.0, 1.0, 0.0, 0.5], "a"), (3, [6.0, 2.0, 0.0, 1.0], "b")] + [(100 + i, [float(x) for x in rng.normal(size=2)], "a") for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    linked: dict = {i: set() for i, _, _ in rows}
    for i, x, a in rows:
        linked[i] |= {j for j, y, b in rows if i != j and a == b and len(x) == len(y) and unit(x) @ unit(y) >= 0.93}
    root = {i: i for i in linked}
    for _ in linked:
        root = {i: min([root[i], *(root[j] for j in linked[i])]) for i in root}
    monkeypatch.setattr(embed_dedup, "FEW", 0)
    got = embed_dedup.near_duplicates(df).distinct().collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (len(linked[i]), root[i], root[i] == i) for i in linked} and len(got) == len(linked)
    found = hilbert_ann.search(df, every=10, k=5).collect()
    for q in {i for i in linked if i % 10 == 0}:
        best: dict = {}
        for i, x, _ in rows:
            for j, y, _ in rows:
                if i == q != j and len(x) == len(y):
                    d = float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))
                    best[j] = min(best.get(j, d), d)
        want = sorted((d, j) for j, d in best.items())[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(n + 1, j) for n, (_, j) in enumerate(want)] == [x[:2] for x in own] and np.allclose([d for d, _ in want], [x[2] for x in own], rtol=1e-15)


def test_hilbert():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = grid[np.argsort(hilbert_ann.hilbert_keys(grid, 3))]
    assert sorted(hilbert_ann.hilbert_keys(grid, 3)) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_licenses(spark, odd):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 900)
    words = mit.split(" ")
    wrapped = "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    docs = spark.createDataFrame(
        [(1, "text\nReleased under the MIT License!\nmore"), (2, "licensed under cc by-nc 4.0"), (3, "nothing of the kind here at all"), (None, "Released under the MIT License."), (4, f"import os\n/*\n * {wrapped}\n */\ndef f(x):\n    return x\n" * 2), (5, "A long line. It goes on and on. Released under the MIT License. And on it goes, word by word.")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in license_scan.with_license(docs).collect()}
    assert got.pop(4)[1] > 0.97 and got == {1: ("MIT", 1.0), 2: ("CC-BY-NC-4.0", 1.0), 3: (None, 0.0), None: ("MIT", 1.0), 5: ("MIT", 1.0)}
    assert license_scan.with_license(odd).count() == odd.count() and license_scan.with_license(odd.limit(0)).count() == 0
    assert {r["license"] for r in license_scan.with_license(docs, templates=spark.createDataFrame([], "license string, text string")).collect()} == {None}


def test_licenses_brute_force(spark, monkeypatch):
    """Every run of segments against every template; and templates in chunks."""
    rng = np.random.default_rng(5)
    templates = [(f"L{i % 7}", " ".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9))))) for i in range(12)]
    seam = lambda: str(rng.choice([" ", ". ", "\n", ", ", "\n\n"], p=[0.7, 0.1, 0.1, 0.05, 0.05]))
    texts = []
    for _ in range(60):
        parts = [x for _ in range(int(rng.integers(0, 5))) for x in (list(rng.choice(list("abcdefgh"), 4)) if rng.random() < 0.5 else templates[int(rng.integers(0, 12))][1].split())]
        texts.append("".join(str(x) + seam() for x in parts))
    sets = {(n, frozenset(zip(w, w[1:]))) for n, t in templates for w in [t.split(" ")]}

    def best(text):
        segments = [w for x in re.split(r"[.!?][ \t\r]|\n", text) if (w := re.findall("[a-z0-9]+", x))]
        found = []
        for i in range(len(segments)):
            for j in range(i, len(segments)):
                w = [x for s in segments[i : j + 1] for x in s]
                a = set(zip(w, w[1:]))
                for name, b in sets:
                    if a and 3 * (len(w) - 1) >= 2 * len(b) and 2 * (len(w) - 1) <= 3 * len(b) and (d := 2.0 * len(a & b) / (len(a) + len(b))) >= 0.8:
                        found.append((-d, name, i))
        return (min(found)[1], -min(found)[0], len({i for _, _, i in found})) if found else (None, 0.0, 0)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(templates, "license string, text string")
    want = {i: best(t) for i, t in enumerate(texts)}
    assert sum(n > 0 for *_, n in want.values()) > 10
    for chunk in (5_000, 4):
        monkeypatch.setattr(license_scan, "CHUNK", chunk)
        assert {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in license_scan.with_license(docs, templates=given).collect()} == want


def test_later_stages_let_go_of_what_a_worker_kept(monkeypatch):
    """A stage that keeps nothing starts without what a stage before it, of the same operator, kept; another finds it again."""
    monkeypatch.setattr(units, "_KEPT", {})
    owner = __name__.rpartition(".")[2]
    units.kept(owner, 1, list)
    seen = lambda batches: iter([len(units._KEPT)])
    assert list(units.tidy(seen)([])) == [1]
    assert list(units.tidy(seen, keeps=False)([])) == [0]
