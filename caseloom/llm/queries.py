"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op9_decontamination
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .language_id import op3_language_id
from .mixing import op4_mix_sources
from .phrases import OP11_SQL, op11_phrases
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .secret_scan import op10_secret_scan
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .token_output import op7_token_output
from .url_filters import OP2_SQL, op2_url_filters
from .vector_codes import OP13_SQL, op13_vector_codes
from .word_trie import op12_word_trie_bpe

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_output": op7_token_output,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_phrases": op11_phrases,
    "op12_word_trie_bpe": op12_word_trie_bpe,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op2_url_filters": OP2_SQL, "op6_jaccard_join": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op11_phrases": OP11_SQL, "op13_vector_codes": OP13_SQL}
