"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_chat_format
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontaminate import op2_decontaminate
from .filter_audit import OP12_SQL, op12_filter_audit
from .language_id import op3_language_id
from .license_scan import op10_license_scan
from .minhash_dedup import OP8_SQL, op8_minhash_dedup
from .ngram_lm import op4_ngram_lm
from .packing import op7_packing
from .pii import op1_pii
from .toxicity import op11_toxicity
from .voronoi_topk import OP5_SQL, op5_voronoi_topk
from .warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_language_id, op4_ngram_lm, op5_voronoi_topk, op6_warc, op7_packing, op8_minhash_dedup, op9_chat_format, op10_license_scan, op11_toxicity, op12_filter_audit, op13_conversation_repair)}
SQL = {"op5_voronoi_topk": OP5_SQL, "op6_warc": OP6_SQL, "op8_minhash_dedup": OP8_SQL, "op9_chat_format": OP9_SQL, "op12_filter_audit": OP12_SQL, "op13_conversation_repair": OP13_SQL}
