"""The subpackage's queries and, where SQL can express them, their DuckDB SQL.

Without SQL, and tested otherwise: 1 and 7 against the tokenizer's library and by
round trips, 2, 3 and 8 against brute force, 4 and 5 against brute force and
held-out labels.
"""

from __future__ import annotations

from . import knn_graph, ngram_lm, packing, pieces, quality, repeats, simhash, token_shards, toxicity, vector_copies

QUERIES = {
    "op1_token_shards": token_shards.op1,
    "op2_cost_packing": packing.op2,
    "op3_ngram_scores": ngram_lm.op3,
    "op4_toxicity": toxicity.op4,
    "op5_quality": quality.op5,
    "op6_simhash_groups": simhash.op6,
    "op7_pieces": pieces.op7,
    "op8_nearest": knn_graph.op8,
    "op9_repeated_passages": repeats.op9,
    "op10_vector_copies": vector_copies.op10,
}

ORACLES: dict[str, str] = {
    "op6_simhash_groups": simhash.ORACLE,
    "op9_repeated_passages": repeats.ORACLE,
    "op10_vector_copies": vector_copies.ORACLE,
}
