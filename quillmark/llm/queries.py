"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillmark.llm.attention_lm import op4_attention_lm
from quillmark.llm.bitsliced import OP3_SQL, op3_bitsliced_topk
from quillmark.llm.length_buckets import OP9_SQL, op9_length_buckets
from quillmark.llm.license_scan import op11_license_scan, op11_sql
from quillmark.llm.lsh_search import op1_lsh_search
from quillmark.llm.ngram_join import OP2_SQL, op2_ngram_join
from quillmark.llm.page_text import op5_page_text
from quillmark.llm.pfair_mix import op10_pfair_mix
from quillmark.llm.quote_threads import op6_quote_threads
from quillmark.llm.toxicity import op8_toxicity
from quillmark.llm.turn_repair import op12_turn_repair
from quillmark.llm.virtual_slots import op7_sql, op7_virtual_slots
from quillmark.llm.whitening import op13_whitening

QUERIES = {
    "op1_lsh_search": op1_lsh_search,
    "op2_ngram_join": op2_ngram_join,
    "op3_bitsliced_topk": op3_bitsliced_topk,
    "op4_attention_lm": op4_attention_lm,
    "op5_page_text": op5_page_text,
    "op6_quote_threads": op6_quote_threads,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_toxicity": op8_toxicity,
    "op9_length_buckets": op9_length_buckets,
    "op10_pfair_mix": op10_pfair_mix,
    "op11_license_scan": op11_license_scan,
    "op12_turn_repair": op12_turn_repair,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op3_bitsliced_topk": OP3_SQL, "op7_virtual_slots": op7_sql(), "op9_length_buckets": OP9_SQL, "op11_license_scan": op11_sql()}
