"""The registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op6_nearest
from .decontam import op2_decontaminate
from .divergence import ORACLE_SQL as DIVERGENCE_SQL, op11_systolic
from .language import op7_language
from .lines import op9_line_chunks
from .pieces import op4_pieces
from .pii import ORACLE_SQL as PII_SQL, op10_pii
from .resample import ORACLE_SQL as RESAMPLE_SQL, op13_position_ngrams
from .secrets import op1_secrets
from .sharding import op5_virtual_slots
from .simhash import op8_simhash
from .token_files import op3_token_planes
from .urls import ORACLE_SQL as URL_SQL, op12_url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_planes": op3_token_planes,
    "op4_pieces": op4_pieces,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_nearest": op6_nearest,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_line_chunks": op9_line_chunks,
    "op10_pii": op10_pii,
    "op11_systolic": op11_systolic,
    "op12_url_rules": op12_url_rules,
    "op13_position_ngrams": op13_position_ngrams,
}

#: The others need hashes, models or iterations that SQL lacks; their tests use brute force.
ORACLES: dict[str, str] = {"op10_pii": PII_SQL, "op11_systolic": DIVERGENCE_SQL, "op12_url_rules": URL_SQL, "op13_position_ngrams": RESAMPLE_SQL}
