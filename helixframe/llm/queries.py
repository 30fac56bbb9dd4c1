"""Queries of this subpackage, by name."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontaminate
from .exact_substrings import op10_exact_substrings
from .fingerprints import op8_fingerprints
from .language_model import op4_language_model
from .line_dedup import op2_line_dedup
from .mixing import op6_mixing
from .near_dedup import OP5_SQL, op5_near_dedup
from .quality import op1_quality
from .token_output import op9_token_output
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_language_model": op4_language_model,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_output": op9_token_output,
    "op10_exact_substrings": op10_exact_substrings,
}
ORACLE_SQL = {"op3_warc": OP3_SQL, "op5_near_dedup": OP5_SQL, "op7_decontaminate": OP7_SQL}
