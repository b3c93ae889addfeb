"""Queries of the corpus operators, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from .align import op13_token_alignment
from .decontaminate import OP7_SQL, op7_decontamination
from .media import op5_media_columns
from .near import OP9_SQL, op9_ngram_jaccard_join
from .periods import OP12_SQL, op12_periodic_runs
from .pieces import op4_sentencepiece
from .pii import op3_pii
from .quality import op10_quality_classifier
from .sharding import OP6_SQL, op6_sharding
from .simhash import op11_simhash_near_dedup
from .substrings import OP8_SQL, op8_substring_dedup
from .suffixes import OP2_SQL, op2_suffix_array_dedup
from .tokens import op1_token_blocks

QUERIES = [op1_token_blocks, op2_suffix_array_dedup, op3_pii, op4_sentencepiece, op5_media_columns, op6_sharding, op7_decontamination, op8_substring_dedup, op9_ngram_jaccard_join, op10_quality_classifier, op11_simhash_near_dedup, op12_periodic_runs, op13_token_alignment]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2_SQL, "op6_sharding": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op12_periodic_runs": OP12_SQL}
