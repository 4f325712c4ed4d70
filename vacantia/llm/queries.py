"""One query per operator of this package, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm.codebooks import op12_vector_codes
from vacantia.llm.hmm import op10_hidden_markov
from vacantia.llm.language_id import op5_language_id
from vacantia.llm.near_dedup import op1_prob_minhash
from vacantia.llm.nearest import op2_cross_polytope
from vacantia.llm.packing import op4_best_fit_packing
from vacantia.llm.pieces import op7_sentencepiece
from vacantia.llm.pii import op8_pii
from vacantia.llm.quality import op9_quality_rules
from vacantia.llm.repeats import op13_suffix_repeats
from vacantia.llm.runs import op11_periodic_runs
from vacantia.llm.token_files import op3_token_files
from vacantia.llm.warc import OP6_SQL, op6_warc

_QUERIES = (
    op1_prob_minhash,
    op2_cross_polytope,
    op3_token_files,
    op4_best_fit_packing,
    op5_language_id,
    op6_warc,
    op7_sentencepiece,
    op8_pii,
    op9_quality_rules,
    op10_hidden_markov,
    op11_periodic_runs,
    op12_vector_codes,
    op13_suffix_repeats,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL}
