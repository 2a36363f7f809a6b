"""The subpackage's queries and SQL."""

from __future__ import annotations

from siltstone.llm.decontaminate import op5_template_decontamination
from siltstone.llm.embeddings import op2_embedding_cells
from siltstone.llm.erasure import op12_cascading_erasure
from siltstone.llm.html import op8_layout_text
from siltstone.llm.inner import ORACLE as INNER_ORACLE
from siltstone.llm.inner import op11_top_inner_products
from siltstone.llm.lm import op7_bloom_lm
from siltstone.llm.minhash import op1_minmax_dedup
from siltstone.llm.packing import op3_best_fit_packing
from siltstone.llm.quality import op4_rule_quality
from siltstone.llm.runs import op13_lyndon_runs
from siltstone.llm.secrets import op6_secret_scan
from siltstone.llm.toxicity import op9_weak_toxicity
from siltstone.llm.warc import op10_warc_members

QUERIES = {
    f.__name__: f
    for f in (
        op1_minmax_dedup, op2_embedding_cells, op3_best_fit_packing, op4_rule_quality, op5_template_decontamination,
        op6_secret_scan, op7_bloom_lm, op8_layout_text, op9_weak_toxicity, op10_warc_members, op11_top_inner_products,
        op12_cascading_erasure, op13_lyndon_runs,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_top_inner_products": INNER_ORACLE}
