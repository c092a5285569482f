"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from rollout_tables.llm import (
    ann, chat, decontaminate, divergence, fim, lm, oracle, pieces, pii, quality, sharding, simhash, substring, toxicity,
)

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.query,
    "op2_substring_dedup": substring.query,
    "op3_pii_surrogates": pii.query,
    "op4_quality_classifier": quality.query,
    "op5_sentencepiece": pieces.query,
    "op6_ann_permutation": ann.query,
    "op7_chat_template": chat.query,
    "op8_lm_pseudo_likelihood": lm.query,
    "op9_simhash_dedup": simhash.query,
    "op10_toxicity": toxicity.query,
    "op11_hypergeometric_sharding": sharding.query,
    "op12_fill_in_middle": fim.query,
    "op13_source_divergence": divergence.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = dict(oracle.SQL)
