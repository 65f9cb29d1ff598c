"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from .decontamination import ORACLE_SQL as CONTAINMENT_SQL
from .decontamination import op10_minhash_containment
from .fingerprints import op1_chroma_fingerprints
from .lattice import op3_lattice_likelihood
from .lexical_search import ORACLE_SQL as SEARCH_SQL
from .lexical_search import op13_pipelined_terms
from .ngram_join import ORACLE_SQL as NGRAM_JOIN_SQL
from .ngram_join import op5_token_group_join
from .packing import op7_bounded_packing
from .preferences import ORACLE_SQL as PREFERENCE_SQL
from .preferences import op2_preference_format
from .rules import op9_rule_quality
from .sharding import ORACLE_SQL as SHARDING_SQL
from .sharding import op12_feistel_shards
from .suffix_dedup import op6_suffix_dedup
from .token_files import op8_mph_token_files
from .toxicity import op4_gru_toxicity
from .vector_codes import ORACLE_SQL as CODES_SQL
from .vector_codes import op11_slice_intersect_codes

QUERIES = {
    "op1_chroma_fingerprints": op1_chroma_fingerprints,
    "op2_preference_format": op2_preference_format,
    "op3_lattice_likelihood": op3_lattice_likelihood,
    "op4_gru_toxicity": op4_gru_toxicity,
    "op5_token_group_join": op5_token_group_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_bounded_packing": op7_bounded_packing,
    "op8_mph_token_files": op8_mph_token_files,
    "op9_rule_quality": op9_rule_quality,
    "op10_minhash_containment": op10_minhash_containment,
    "op11_slice_intersect_codes": op11_slice_intersect_codes,
    "op12_feistel_shards": op12_feistel_shards,
    "op13_pipelined_terms": op13_pipelined_terms,
}

ORACLE_SQL: dict[str, str] = {
    "op5_token_group_join": NGRAM_JOIN_SQL,
    "op2_preference_format": PREFERENCE_SQL,
    "op10_minhash_containment": CONTAINMENT_SQL,
    "op11_slice_intersect_codes": CODES_SQL,
    "op12_feistel_shards": SHARDING_SQL,
    "op13_pipelined_terms": SEARCH_SQL,
}
