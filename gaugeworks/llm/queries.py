"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gaugeworks.llm import alignment, decontaminate, divergence, imatch, jaccard, ledger, licences, media, packing, quality, quotes, tokens, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard.op1,
        "op2_benchmark_decontamination": decontaminate.op2,
        "op3_packing": packing.op3,
        "op4_quality_classifier": quality.op4,
        "op5_warc_revisits": warc.op5,
        "op6_token_counts": tokens.op6,
        "op7_secret_scans": ledger.op7,
        "op8_chat_formatting": quotes.op8,
        "op9_license_scans": licences.op9,
        "op10_media_columns": media.op10,
        "op11_source_divergence_audit": divergence.op11,
        "op12_document_fingerprints": imatch.op12,
        "op13_cross_tokenizer_alignment": alignment.op13,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": jaccard.OP1_SQL, "op2_benchmark_decontamination": decontaminate.OP2_SQL, "op5_warc_revisits": warc.OP5_SQL, "op8_chat_formatting": quotes.OP8_SQL, "op9_license_scans": licences.OP9_SQL, "op11_source_divergence_audit": divergence.OP11_SQL, "op12_document_fingerprints": imatch.OP12_SQL}
