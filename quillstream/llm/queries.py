"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .html_extract import op2_html_extract
from .jaccard import op6_jaccard_join
from .mixing import op7_mixing
from .oracle import OP3, OP7
from .packing import op8_packing
from .neighbours import op4_nearest
from .quality import op5_quality_rules
from .secrets import op9_secret_scan
from .substring import op3_substring_dedup
from .toxicity import op10_toxicity
from .urls import ORACLE_SQL as URL_SQL
from .urls import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_html_extract": op2_html_extract,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest": op4_nearest,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": URL_SQL, "op3_substring_dedup": OP3, "op7_mixing": OP7}
