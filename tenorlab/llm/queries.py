"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from tenorlab.llm.bpe import op5_bpe
from tenorlab.llm.embedding_dedup import op8_embedding_dedup
from tenorlab.llm.html_extraction import op9_html_extraction
from tenorlab.llm.jaccard_join import op6_jaccard_join
from tenorlab.llm.language_id import op3_language_id
from tenorlab.llm.license_scan import op1_license_scan
from tenorlab.llm.oracles import ORACLES  # noqa: F401
from tenorlab.llm.packing import op7_packing
from tenorlab.llm.quality_rules import op4_quality_rules
from tenorlab.llm.secret_scan import op2_secret_scan
from tenorlab.llm.sharding import op10_sharding

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_secret_scan, op3_language_id, op4_quality_rules, op5_bpe, op6_jaccard_join, op7_packing, op8_embedding_dedup, op9_html_extraction,
        op10_sharding,
    )
}

