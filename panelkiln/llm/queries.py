"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from panelkiln.llm.bpe import op10_bpe_round_trip
from panelkiln.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from panelkiln.llm.near_dups import OP4_SQL, op4_near_duplicates
from panelkiln.llm.packing import op8_packing
from panelkiln.llm.secrets import op1_secret_scan
from panelkiln.llm.toxicity import op2_toxicity
from panelkiln.llm.tool_calls import op7_tool_calls
from panelkiln.llm.topk import OP5_SQL, op5_exact_top_k
from panelkiln.llm.url_rules import op9_url_rules
from panelkiln.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_warc": op6_warc,
    "op7_tool_calls": op7_tool_calls,
    "op8_packing": op8_packing,
    "op9_url_rules": op9_url_rules,
    "op10_bpe_round_trip": op10_bpe_round_trip,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op5_exact_top_k": OP5_SQL, "op6_warc": OP6_SQL}
