"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .chat_formatting import ORACLE_OP9, op9_chat_formatting
from .hard_negatives import ORACLE_OP12, op12_hard_negatives
from .language_id import op7_language_id
from .line_dedup import op6_line_dedup
from .ngram_join import op8_ngram_jaccard_join
from .packing import op1_packing
from .pii import op5_pii
from .quality_rules import op10_quality_rules
from .secret_scans import op2_secret_scans
from .sentencepiece_coding import op4_sentencepiece
from .sharding import op13_sharding
from .source_divergence import ORACLE_OP11, op11_source_divergence
from .topk_search import ORACLE_OP3, op3_exact_topk

QUERIES = {f.__name__: f for f in (op1_packing, op2_secret_scans, op3_exact_topk, op4_sentencepiece, op5_pii, op6_line_dedup, op7_language_id, op8_ngram_jaccard_join, op9_chat_formatting, op10_quality_rules, op11_source_divergence, op12_hard_negatives, op13_sharding)}
ORACLE_SQL: dict[str, str] = {"op3_exact_topk": ORACLE_OP3, "op9_chat_formatting": ORACLE_OP9, "op11_source_divergence": ORACLE_OP11, "op12_hard_negatives": ORACLE_OP12}
