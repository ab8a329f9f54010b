"""The registered queries of this package and the SQL that says the same, where SQL can."""

from __future__ import annotations

from cutlake.llm import filter_audit, quality_rules, topk
from cutlake.llm.byte_bpe import op3_byte_bpe
from cutlake.llm.common import Plan
from cutlake.llm.conversation_repair import op11_conversation_repair
from cutlake.llm.filter_audit import op12_filter_audit
from cutlake.llm.html_text import op13_html_text
from cutlake.llm.line_dedup import op9_line_dedup
from cutlake.llm.packing import op2_packing
from cutlake.llm.quality_classifier import op8_quality_classifier
from cutlake.llm.quality_rules import op7_quality_rules
from cutlake.llm.simhash import op4_simhash
from cutlake.llm.token_counts import op10_token_counts
from cutlake.llm.token_files import op6_token_files
from cutlake.llm.topk import op5_topk
from cutlake.llm.toxicity import op1_toxicity

_PLANS: tuple[Plan, ...] = (
    op1_toxicity, op2_packing, op3_byte_bpe, op4_simhash, op5_topk, op6_token_files, op7_quality_rules,
    op8_quality_classifier, op9_line_dedup, op10_token_counts, op11_conversation_repair, op12_filter_audit,
    op13_html_text,
)


def plans() -> dict[str, Plan]:
    return {plan.__name__: plan for plan in _PLANS}


def sql() -> dict[str, str]:
    return {"op5_topk": topk.SQL, "op7_quality_rules": quality_rules.SQL, "op12_filter_audit": filter_audit.SQL}
