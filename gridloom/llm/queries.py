"""The queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, fingerprint, mixing, pii, quality, simhash_dedup, token_counts, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pareto_mixing": mixing.op1_pareto_mixing,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_pii": pii.op3_pii,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "pipeline": _pipeline,
}

ORACLE_SQL = {"op1_pareto_mixing": mixing.ORACLE_SQL, "op5_embedding_dedup": embedding_dedup.ORACLE_SQL, "op6_chat_format": chat_format.ORACLE_SQL}
