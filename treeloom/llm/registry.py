"""Queries of the corpus operators, by name; and their SQL, where SQL can express them."""

from treeloom.llm import embeddings, langid, mixing, ngram_join, oracles, packing, pii, quality, secrets, shards, substrings


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_token_shards": shards.op3_token_shards,
        "op4_language_id": langid.op4_language_id,
        "op5_mixing": mixing.op5_mixing,
        "op6_embedding_neardup": embeddings.op6_embedding_neardup,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_suffix_array_dedup": substrings.op9_suffix_array_dedup,
        "op10_pii": pii.op10_pii,
        # Parts of the operators above that SQL can express, where it cannot express the whole.
        "secrets_base": secrets.secrets_base,
        "quality_ablation": quality.quality_ablation,
        "pii_base": pii.pii_base,
    }


def oracle_sql() -> dict:
    """The rest is tested against brute force: tokenizers and models are beyond SQL."""
    return {
        "op2_ngram_jaccard_join": oracles.squeezed(oracles.ngram_jaccard_join()),
        "op6_embedding_neardup": oracles.squeezed(oracles.embedding_neardup()),
        "op8_quality_rules": oracles.squeezed(oracles.quality_rules()),
        "op9_suffix_array_dedup": oracles.squeezed(oracles.repeats()),
        "secrets_base": oracles.squeezed(oracles.secrets_base()),
        "quality_ablation": oracles.squeezed(oracles.quality_ablation()),
        "pii_base": oracles.squeezed(oracles.pii_base()),
    }
