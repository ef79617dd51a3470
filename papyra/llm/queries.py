"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import classlm, decontam, embeddings, langid, lines, minhash, packing, passages, phrases, pipeline, quality, repair, rules, urls


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_embedding_dedup": embeddings.op3_embedding_dedup,
        "op4_lm_scoring": classlm.op4_lm_scoring,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_substring_dedup": passages.op6_substring_dedup,
        "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
        "op8_url_filters": urls.op8_url_filters,
        "op9_language_id": langid.op9_language_id,
        "op10_minhash_dedup": minhash.op10_minhash_dedup,
        "op11_quality_rules": rules.op11_quality_rules,
        "op12_phrase_mining": phrases.op12_phrase_mining,
        "op13_conversation_repair": repair.op13_conversation_repair,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": embeddings.OP3_SQL, "op5_line_dedup": lines.OP5_SQL, "op10_minhash_dedup": minhash.OP10_SQL, "op11_quality_rules": rules.OP11_SQL, "op12_phrase_mining": phrases.OP12_SQL}
