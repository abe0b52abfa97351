"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import (
    op1_license,
    op2_toxicity,
    op3_packing,
    op4_language,
    op5_topk,
    op6_neardup,
    op7_fingerprint,
    op8_mixing,
    op9_pii,
    op10_quality,
    op11_bestfit,
    op12_whitening,
    op13_merkle,
)

QUERIES = {
    "op1_license_scan": op1_license.op1_license_scan,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_packing": op3_packing.op3_packing,
    "op4_language_id": op4_language.op4_language_id,
    "op5_top_k": op5_topk.op5_top_k,
    "op6_near_duplicates": op6_neardup.op6_near_duplicates,
    "op7_fingerprint": op7_fingerprint.op7_fingerprint,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_pii": op9_pii.op9_pii,
    "op10_quality": op10_quality.op10_quality,
    "op11_best_fit": op11_bestfit.op11_best_fit,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_merkle": op13_merkle.op13_merkle,
}

SQL = {
    "op5_top_k": op5_topk.ORACLE,
    "op6_near_duplicates": op6_neardup.ORACLE,
    "op8_mixing": op8_mixing.ORACLE,
    "op13_merkle": op13_merkle.ORACLE,
}
