"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from .importance import op1_importance_resampling
from .language import op12_language_id
from .licenses import op6_licenses, op6_notices
from .licenses import oracle as license_oracle
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_duplicates import OP9_SQL, op9_near_duplicates
from .nearest import op3_nearest
from .packing import op7_packing
from .personal_data import op10_personal_data
from .positional_index import OP5_SQL, op5_decontamination
from .sharding import op4_sharding
from .spelling import OP13_SQL, op13_spelling_variants
from .suffix_tree import op2_suffix_tree
from .token_files import op8_token_files

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_nearest": op3_nearest,
    "op4_sharding": op4_sharding,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_personal_data": op10_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}
#: Beside the ten: strict licence labels, which op6_licenses, whose SQL stays, doesn't have.
MORE_QUERIES = {"license_notices": op6_notices}
ORACLE_SQL: dict[str, str] = {"op5_decontamination": OP5_SQL, "op6_licenses": license_oracle(), "op9_near_duplicates": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_spelling_variants": OP13_SQL}
