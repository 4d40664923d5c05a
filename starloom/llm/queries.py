"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_alignment
from .chat import SQL as OP11_SQL
from .chat import op11_chat
from .digest import op2_fingerprints
from .divergence import SQL as OP12_SQL
from .divergence import op12_source_divergence
from .linecrf import op5_quality
from .media import op4_media
from .neardup import op9_near_duplicates
from .packing import op3_packing
from .pieces import op8_pieces
from .pii import op1_pii
from .secrets import op10_secrets
from .toxicity import op6_toxicity
from .urls import SQL as OP7_SQL
from .urls import op7_urls

QUERIES = {
    "op1_pii": op1_pii,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_urls": op7_urls,
    "op8_pieces": op8_pieces,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secrets": op10_secrets,
    "op11_chat": op11_chat,
    "op12_source_divergence": op12_source_divergence,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op7_urls": OP7_SQL,
    "op11_chat": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
