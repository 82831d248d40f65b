"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .filter_audit import AUDIT_SQL, op11_filter_audit
from .hard_negatives import NEGATIVES_SQL, op13_hard_negatives
from .language_model import op5_language_model
from .mixing import op6_mix_sources
from .neighbours import op10_nearest
from .ngram_join import op12_ngram_join
from .personal import op8_personal_data
from .pieces import op3_sentencepiece
from .quality import QUALITY_SQL, op9_quality_rules
from .repeats import op7_repeats
from .simhash import op2_simhash
from .token_counts import op4_token_counts
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_language_model": op5_language_model,
    "op6_mix_sources": op6_mix_sources,
    "op7_repeats": op7_repeats,
    "op8_personal_data": op8_personal_data,
    "op9_quality_rules": op9_quality_rules,
    "op10_nearest": op10_nearest,
    "op11_filter_audit": op11_filter_audit,
    "op12_ngram_join": op12_ngram_join,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {"op9_quality_rules": QUALITY_SQL, "op11_filter_audit": AUDIT_SQL, "op13_hard_negatives": NEGATIVES_SQL}
