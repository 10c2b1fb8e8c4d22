"""Queries of this subpackage for the driver, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tarmac.llm import chat, exact_dedup, hard_negatives, maxent, mixing, packing, pii, prefix_join, prefix_trie, sharding, simhash, topk, toxicity
from tarmac.llm.common import prepare


def _ready(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {
    f.__name__: _ready(f)
    for f in (
        maxent.op1_lm_scoring,
        exact_dedup.op2_exact_dedup,
        mixing.op3_pivotal_mixing,
        pii.op4_personal_data,
        chat.op5_chat_formatting,
        simhash.op6_simhash_near_dedup,
        packing.op7_curve_packing,
        toxicity.op8_toxicity,
        topk.op9_exact_top_k,
        sharding.op10_vector_sharding,
        hard_negatives.op11_hard_negatives,
        prefix_trie.op12_conversation_trie,
        prefix_join.op13_ngram_jaccard_join,
    )
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_conversation_trie": prefix_trie.ORACLE,
}
