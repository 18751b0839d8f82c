"""Queries that apply the corpus operators to whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from kinelake.llm import exact_dedup, mixing
from kinelake.llm.ann import op9_ann
from kinelake.llm.byte_bpe import op4_byte_bpe
from kinelake.llm.exact_dedup import op5_exact_dedup
from kinelake.llm.language_model import op2_lm_scoring
from kinelake.llm.minhash_dedup import op8_minhash_dedup
from kinelake.llm.mixing import op10_mixing
from kinelake.llm.quality import op7_quality
from kinelake.llm.repeated_spans import op1_suffix_array_dedup
from kinelake.llm.sharding import op6_sharding
from kinelake.llm.toxicity import op3_toxicity


def queries() -> dict:
    listed = (op1_suffix_array_dedup, op2_lm_scoring, op3_toxicity, op4_byte_bpe, op5_exact_dedup, op6_sharding, op7_quality, op8_minhash_dedup, op9_ann, op10_mixing)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.ORACLE_SQL, "op10_mixing": mixing.oracle_sql()}
