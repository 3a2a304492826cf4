"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, licenses, substrings, topk
from .classlm import op3_class_exchange_lm
from .decontamination import op1_spaced_seed_decontamination
from .langid import op5_ftrl_language
from .licenses import op6_dice_licenses
from .packing import op10_sum_of_squares_packing
from .pii import op7_feistel_pseudonyms
from .simhash import op2_simhash_trie
from .substrings import op4_difference_cover_dedup
from .topk import op9_norm_sorted_products
from .toxicity import op8_counterfactual_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seed_decontamination,
        op2_simhash_trie,
        op3_class_exchange_lm,
        op4_difference_cover_dedup,
        op5_ftrl_language,
        op6_dice_licenses,
        op7_feistel_pseudonyms,
        op8_counterfactual_toxicity,
        op9_norm_sorted_products,
        op10_sum_of_squares_packing,
    )
}

ORACLE_SQL: dict[str, str] = decontamination.ORACLE_SQL | substrings.ORACLE_SQL | licenses.ORACLE_SQL | topk.ORACLE_SQL
