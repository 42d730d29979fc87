"""The corpus queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tradeloom.llm import byte_bpe, collocations, exact_dedup, filter_audit, language_id, media, packing, quality, secrets, sharding, simhash, substring_dedup, weighted_samples


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_packing": packing.op5_packing,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_sharding": sharding.op7_sharding,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_media": media.op9_media,
        "pipeline": corpus_pipeline.run,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_fingerprints": weighted_samples.op11_fingerprints,
        "op12_collocations": collocations.op12_collocations,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: tokenizers (5, 6, 10), trained models (1, 3), bit counts of hashes (2), random draws (7, 11) and media formats (9)."""
    return {"op4_substring_dedup": substring_dedup.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op12_collocations": collocations.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
