"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from .archives import OP10_SQL, op10_warc
from .decontaminate import OP7_SQL, op7_decontamination
from .language import op8_language
from .licenses import op9_licenses
from .lm_score import op5_lm_score
from .minhash_dedup import OP2_SQL, op2_minhash_dedup
from .packing import op6_packing
from .quality import op4_quality
from .url_filter import OP3_SQL, op3_url_filter
from .vector_dedup import OP1_SQL, op1_lattice_dedup

QUERIES = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_lm_score": op5_lm_score,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {
    "op1_lattice_dedup": OP1_SQL,
    "op2_minhash_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op10_warc": OP10_SQL,
}
