"""Operators of a training-data pipeline, and the queries that apply them."""

from __future__ import annotations

from .alignment import op12_alignment
from .chat import OP9_SQL, op9_chat
from .decontam import op5_decontamination
from .lexical import OP11_SQL, op11_lexical
from .media import op7_media
from .ngram_join import op6_ngram_join
from .packing import op2_packing
from .pii import op1_pii
from .secrets import op4_secrets
from .substring import op3_substring_dedup
from .toxicity import op8_toxicity
from .url_filter import op13_url_filter
from .warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_packing, op3_substring_dedup, op4_secrets, op5_decontamination, op6_ngram_join, op7_media, op8_toxicity, op9_chat, op10_warc, op11_lexical, op12_alignment, op13_url_filter)}
ORACLE_SQL = {"op9_chat": OP9_SQL, "op10_warc": OP10_SQL, "op11_lexical": OP11_SQL}
