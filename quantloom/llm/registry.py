"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from quantloom.llm import exact_dedup, fill_in_middle, jaccard_join, license_scan, periodic_runs, suffix_dedup, url_filter
from quantloom.llm.decontamination import op5_decontamination
from quantloom.llm.exact_dedup import op8_exact_dedup
from quantloom.llm.fill_in_middle import op13_fill_in_middle
from quantloom.llm.jaccard_join import op9_jaccard_join
from quantloom.llm.license_scan import license_base_phrases, op3_license_scan
from quantloom.llm.lm_score import op4_lm_score
from quantloom.llm.packing import op7_packing
from quantloom.llm.periodic_runs import op11_periodic_runs
from quantloom.llm.quality import op6_quality
from quantloom.llm.suffix_dedup import op1_suffix_dedup
from quantloom.llm.token_frames import op12_token_frames
from quantloom.llm.toxicity import op10_toxicity
from quantloom.llm.url_filter import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_url_filter, op3_license_scan, op4_lm_score, op5_decontamination, op6_quality, op7_packing, op8_exact_dedup,
        op9_jaccard_join, op10_toxicity, op11_periodic_runs, op12_token_frames, op13_fill_in_middle, license_base_phrases,
    )
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE, "op2_url_filter": url_filter.ORACLE, "license_base_phrases": license_scan.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE
}
