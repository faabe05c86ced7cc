"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from sparkloom.llm import op3_topk, op10_decontaminate
from sparkloom.llm.op1_quality import op1_quality
from sparkloom.llm.op2_html import op2_html
from sparkloom.llm.op4_chat import op4_chat
from sparkloom.llm.op5_suffix import op5_suffix
from sparkloom.llm.op6_minhash import op6_minhash
from sparkloom.llm.op7_packing import op7_packing
from sparkloom.llm.op8_pii import op8_pii
from sparkloom.llm.op9_licenses import op9_licenses

QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_topk": op3_topk.op3_topk,
    "op4_chat": op4_chat,
    "op5_suffix": op5_suffix,
    "op6_minhash": op6_minhash,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate.op10_decontaminate,
}
SQL = {"op3_topk": op3_topk.SQL, "op10_decontaminate": op10_decontaminate.SQL}
