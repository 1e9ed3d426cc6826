"""The queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import ctw, exact_dedup, langid, line_chunks, media, near_dedup, packing, preference, quality, sentencepiece_codec

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_ctw_scoring": ctw.op3_ctw_scoring,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_preference_format": preference.op6_preference_format,
    "op7_line_dedup": line_chunks.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": langid.op9_language_id,
    "op10_media_columns": media.op10_media_columns,
}
SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op6_preference_format": preference.OP6_SQL}
