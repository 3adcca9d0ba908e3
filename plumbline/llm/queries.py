"""Registered queries of this subpackage and the SQL of those that SQL can express."""
from __future__ import annotations

from .fingerprint import op8_fingerprints
from .jaccard import op6_jaccard_join
from .language import op9_language
from .mixing import op10_mixing
from .ngram_trie import op2_language_model
from .oracles import ORACLES
from .packing import op5_packing
from .personal import op12_personal_data
from .quality import op7_quality_rules
from .rans import op3_token_files
from .secrets import op4_secret_scan
from .sharding import op1_sharding
from .turn_trie import op13_conversation_trie
from .whitening import op11_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_model": op2_language_model,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_fingerprints": op8_fingerprints,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_trie": op13_conversation_trie,
}
