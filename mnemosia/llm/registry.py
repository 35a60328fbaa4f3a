"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontaminate import ORACLE as OP2_SQL
from .decontaminate import op2_decontaminate
from .divergence import ORACLE as OP13_SQL
from .divergence import op13_source_divergence
from .html_text import op1_html_text
from .licences import ORACLE as OP7_SQL
from .licences import op7_license_scan
from .maxent import op10_maxent
from .minhash import op9_minhash
from .pii import op12_pii
from .quality import ABLATIONS_SQL, op5_quality_rules, quality_ablations
from .quality import ORACLE as OP5_SQL
from .secrets import op8_secret_scan
from .substrings import op3_substring_dedup
from .url_filter import ORACLE as OP4_SQL
from .url_filter import op4_url_filter
from .whitening import op11_whitening

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash": op9_minhash,
    "op10_maxent": op10_maxent,
    "op11_whitening": op11_whitening,
    "op12_pii": op12_pii,
    "op13_source_divergence": op13_source_divergence,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL = {
    "op2_decontaminate": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "op7_license_scan": OP7_SQL,
    "op13_source_divergence": OP13_SQL,
}
