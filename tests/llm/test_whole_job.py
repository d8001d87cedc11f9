"""Cases in which an operator or a stage of the pipeline once did less than the whole job."""

from __future__ import annotations

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines(spark):
    """The pipeline's line dedup removes short lines by their spread, as it does long ones."""
    docs = spark.createDataFrame([(i, f"own words of {i}\nLes.\n\nx", "en", f"s{i % 5 if i < 5 else 0}", 0) for i in range(6)], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got[0] == "own words of 0\nLes.\n\nx" and all(got[i] == f"own words of {i}\n" for i in range(1, 6))


def test_near_copies(spark):
    """The pipeline's near-dedup is by shingles of five words at 0.8: against all pairs, with copies that SimHash at 2 bits leaves."""
    import numpy as np

    from maskara.llm import shingles, simhash

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(6, 150))))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5):
            own = list(base)
            for i in rng.integers(0, len(own), edits):
                own[i] = str(rng.choice(words))
            texts.append(" ".join(own))
    texts += ["same line " * 30 + f"x{i}" for i in range(9)] + ["", None, " ", "one two", "One  two", "one two three", texts[0].upper()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0), (None, "alone here", "en", "s", 0)], DOCS)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    want = sorted({*root})
    out = corpus_pipeline.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == want
    # rows without a doc_id stay only by a component of their own; then all rows of that id do, as before
    assert "alone here" in {r["text"] for r in rows if r["doc_id"] is None}
    assert simhash.keep_one(docs).filter("doc_id IS NOT NULL").count() > len(want)
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_links_of_vectors_of_any_size(spark):
    """Lengths whose squares leave the range of doubles link by their angle, and with nothing else."""
    import numpy as np

    from maskara.llm import embed_dedup

    a, b = np.array([1.0, 2.0, 3.0]), np.array([-3.0, 1.0, 0.5])
    rows = [(i, (v * s).tolist(), "l") for i, (v, s) in enumerate((v, s) for v in (a, b) for s in (1e200, 1e200, 1.0, 1e-200, 1e-310))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {i: (4, i // 5 * 5) for i in range(10)}


def test_rank_counts_cells(spark):
    import numpy as np

    from maskara.llm import embed_dedup

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    index = embed_dedup.MultiIndex(x, 6, 0.93, 0.995)
    unit = embed_dedup._unit(x)
    cells = rng.integers(0, 36, 200)
    a, b = (embed_dedup._squared(u, c) for u, c in ((unit[:, :4], index.books[0]), (unit[:, 4:], index.books[1])))
    sums = (a[:, :, None] + b[:, None, :]).reshape(200, -1)
    assert np.abs(index.rank(unit, cells) - (sums < sums[np.arange(200), cells][:, None]).sum(1)).max() <= 1  # the cell itself may be on either side by rounding
