"""The subpackage's queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontaminate import op9_decontaminate
from .language import op3_language
from .lattice import op7_lattice
from .linededup import op10_line_dedup
from .quality import op4_quality
from .secrets import op8_secrets
from .sharding import op1_kd_sharding
from .simhash import op2_simhash
from .toxicity import op6_toxicity

QUERIES = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_lattice": op7_lattice,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
}

#: None of these results can be had in plain SQL (trained models, hashes that DuckDB lacks,
#: alignments); tests/llm holds each against a brute-force version instead.
ORACLE_SQL: dict[str, str] = {}
