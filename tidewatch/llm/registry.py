"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard_join import OP1_SQL, op1_jaccard_join, op1_jaccard_links
from .licenses import op5_license_scan
from .mixing import op2_mix_sources
from .pitman_yor import op8_lm_score
from .secrets import op6_secret_scan
from .token_files import op10_token_files
from .toxicity import op7_toxicity
from .url_filter import OP3_SQL, op3_url_filter


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op1_jaccard_links": op1_jaccard_links,
        "op2_mix_sources": op2_mix_sources,
        "op4_decontaminate": op4_decontaminate,
        "op3_url_filter": op3_url_filter,
        "op5_license_scan": op5_license_scan,
        "op6_secret_scan": op6_secret_scan,
        "op7_toxicity": op7_toxicity,
        "op8_lm_score": op8_lm_score,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict:
    return {"op1_jaccard_join": OP1_SQL, "op3_url_filter": OP3_SQL, "op4_decontaminate": OP4_SQL, "op9_exact_dedup": OP9_SQL}
