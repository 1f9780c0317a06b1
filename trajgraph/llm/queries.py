"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .common import Query
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op2_html_extract
from .kdtree import OP5_SQL, op5_topk
from .langid import op7_language
from .lexical import OP11_SQL, op11_lexical
from .negatives import OP13_SQL, op13_negatives
from .packing import op1_pack
from .pieces import op9_pieces
from .quality import op12_quality
from .secrets import op3_secret_scan
from .simhash import op4_simhash
from .substring import OP6_SQL, op6_substring

QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_html_extract": op2_html_extract,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash": op4_simhash,
    "op5_topk": op5_topk,
    "op6_substring": op6_substring,
    "op7_language": op7_language,
    "op8_chat_format": op8_chat_format,
    "op9_pieces": op9_pieces,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical": op11_lexical,
    "op12_quality": op12_quality,
    "op13_negatives": op13_negatives,
}
SQL: dict[str, str] = {
    "op6_substring": OP6_SQL,
    "op5_topk": OP5_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_lexical": OP11_SQL,
    "op13_negatives": OP13_SQL,
}
