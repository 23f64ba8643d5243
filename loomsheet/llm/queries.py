"""The queries of this subpackage, by name; ``__spark_entry__`` adds them when it can."""

from __future__ import annotations

from .embeddings import OP5_SQL, op5_collision_counting_links
from .fingerprints import OP3_SQL, op3_winnowing
from .language_id import op1_error_correcting_language_id
from .minhash import OP8_SQL, op8_bag_minhash
from .packing import op7_sum_of_squares_packing
from .pii import OP4_SQL, op4_information_theoretic_pii
from .repeats import OP2_SQL, OP10_SQL, op2_rabin_karp_substrings, op10_suffix_array_substrings
from .sentencepieces import op6_streaming_viterbi_pieces
from .toxicity import op9_boosted_toxicity


def queries() -> dict:
    found = [
        op1_error_correcting_language_id,
        op2_rabin_karp_substrings,
        op3_winnowing,
        op4_information_theoretic_pii,
        op5_collision_counting_links,
        op6_streaming_viterbi_pieces,
        op7_sum_of_squares_packing,
        op8_bag_minhash,
        op9_boosted_toxicity,
        op10_suffix_array_substrings,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express; the others are tested against plain versions."""
    return {"op2_rabin_karp_substrings": OP2_SQL, "op3_winnowing": OP3_SQL, "op4_information_theoretic_pii": OP4_SQL, "op5_collision_counting_links": OP5_SQL, "op8_bag_minhash": OP8_SQL, "op10_suffix_array_substrings": OP10_SQL}
