"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from rolecall.llm.bagminhash import op9_bagminhash
from rolecall.llm.brown import op2_brown
from rolecall.llm.cap_filters import OP12_SQL, op12_cap_filters
from rolecall.llm.collocations import OP11_SQL, op11_collocations
from rolecall.llm.decontaminate import OP1_SQL, op1_decontaminate
from rolecall.llm.langid import op7_langid
from rolecall.llm.license_scan import op6_license_scan
from rolecall.llm.line_rules import OP3_SQL, op3_line_rules
from rolecall.llm.lpf_dedup import op4_lpf_dedup
from rolecall.llm.packing import op10_packing
from rolecall.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from rolecall.llm.toxicity import op5_toxicity
from rolecall.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_brown": op2_brown,
    "op3_line_rules": op3_line_rules,
    "op4_lpf_dedup": op4_lpf_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_langid": op7_langid,
    "op8_warc": op8_warc,
    "op9_bagminhash": op9_bagminhash,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_cap_filters": op12_cap_filters,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op1_decontaminate": OP1_SQL,
    "op3_line_rules": OP3_SQL,
    "op8_warc": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_cap_filters": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
