"""The queries of this subpackage, and SQL for those that SQL can express."""

from bazaarlake.llm.collocations import OP13_SQL, op13_collocations
from bazaarlake.llm.cover_tree import OP12_SQL, op12_top_k
from bazaarlake.llm.decontaminate import OP8_SQL, op8_decontaminate
from bazaarlake.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from bazaarlake.llm.html_main import op4_html_main
from bazaarlake.llm.license_scan import OP10_SQL, op10_license_scan
from bazaarlake.llm.lm_score import op9_lm_scores
from bazaarlake.llm.merkle import OP11_SQL, op11_merkle_manifest
from bazaarlake.llm.mixing import op7_mixing
from bazaarlake.llm.ngram_jaccard import OP1_SQL, op1_ngram_jaccard
from bazaarlake.llm.toxicity import op3_toxicity
from bazaarlake.llm.url_rules import OP6_SQL, op6_url_rules
from bazaarlake.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_exact_dedup, op3_toxicity, op4_html_main, op5_warc, op6_url_rules, op7_mixing, op8_decontaminate, op9_lm_scores, op10_license_scan, op11_merkle_manifest, op12_top_k, op13_collocations)
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op6_url_rules": OP6_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_license_scan": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_top_k": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
