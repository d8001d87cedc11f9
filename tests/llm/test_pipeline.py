"""The pipeline's stages on the smallest tables, and SQL of the queries that have it."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from maskara.llm import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return df.astype(str).sort_values(list(df.columns)).values.tolist()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    p = Path(SF, "documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_stages(spark, tmp_path):
    import tokenizers

    from maskara.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "bpe":
            assert docs.columns == columns
    assert kept["language_id"] >= 195 and kept["line_dedup"] == kept["language_id"] and kept["simhash"] <= kept["line_dedup"]
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids)) for r in before.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == want
