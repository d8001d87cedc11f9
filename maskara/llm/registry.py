"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import bpe, collocations, embed_dedup, fim, hilbert_ann, langid, license_scan, line_dedup, mixing, repeats, simhash, token_store, toxicity


def queries() -> dict:
    return {"op1_line_dedup": line_dedup.op1, "op2_toxicity": toxicity.op2, "op3_hilbert_ann": hilbert_ann.op3, "op4_language_id": langid.op4, "op5_embedding_dedup": embed_dedup.op5, "op6_simhash": simhash.op6, "op7_source_mixing": mixing.op7, "op8_license_scan": license_scan.op8, "op9_token_store": token_store.op9, "op10_bpe": bpe.op10, "op11_collocations": collocations.op11, "op12_fill_in_middle": fim.op12, "op13_repeats": repeats.op13}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE_SQL, "op7_source_mixing": mixing.ORACLE_SQL, "op8_license_scan": license_scan.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
