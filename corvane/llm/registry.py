"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_benchmark_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .fingerprints import op4_document_fingerprints
from .importance import OP11_SQL, op11_importance_resampling
from .jaccard_join import op2_ngram_jaccard_join
from .language_id import op10_language_id
from .lm_scoring import op6_lm_scoring
from .mixing import op3_source_mixing
from .oracles import OP2_SQL
from .pii import op9_pii
from .quality_trees import op12_quality_classifier
from .token_counts import op1_token_counts
from .toxicity import op7_toxicity
from .url_filters import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_url_filters": op5_url_filters,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op5_url_filters": OP5_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
