"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillmill.llm.decontamination import OP12_SQL, op12_decontamination
from quillmill.llm.licenses import OP8_SQL, op8_license_scans
from quillmill.llm.mixing import op4_mixing
from quillmill.llm.packing import op3_best_fit_packing
from quillmill.llm.phrases import OP13_SQL, op13_collocations
from quillmill.llm.quality import OP9_SQL, op9_quality_rules
from quillmill.llm.secrets import op10_secret_scans
from quillmill.llm.simhash import op5_simhash_near_dedup
from quillmill.llm.spelling import OP11_SQL, op11_spelling_variants
from quillmill.llm.substrings import op7_repeated_substrings
from quillmill.llm.syncmers import op1_syncmer_fingerprints
from quillmill.llm.toxicity import op2_toxicity
from quillmill.llm.urls import OP6_SQL, op6_url_filters

QUERIES = {f.__name__: f for f in (op1_syncmer_fingerprints, op2_toxicity, op3_best_fit_packing, op4_mixing, op5_simhash_near_dedup, op6_url_filters, op7_repeated_substrings, op8_license_scans, op9_quality_rules, op10_secret_scans, op11_spelling_variants, op12_decontamination, op13_collocations)}
ORACLE_SQL = {"op6_url_filters": OP6_SQL, "op8_license_scans": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_collocations": OP13_SQL}
