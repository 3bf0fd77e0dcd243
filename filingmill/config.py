"""Column layouts and tunable settings.

Operators take the layout as an argument, so they run on any table; the values here are
the presets for public labour-condition filings.
"""

from __future__ import annotations

from dataclasses import dataclass

# Canonical name -> header text in the filing workbooks.
FILING_HEADERS: dict[str, str] = {
    "case_number": "CASE_NUMBER",
    "case_status": "CASE_STATUS",
    "decision_date": "DECISION_DATE",
    "visa_class": "VISA_CLASS",
    "job_title": "JOB_TITLE",
    "soc_code": "SOC_CODE",
    "employer_name": "EMPLOYER_NAME",
    "trade_name_dba": "TRADE_NAME_DBA",
    "pw_wage_level": "PW_WAGE_LEVEL",
    "h1b_dependent": "H-1B_DEPENDENT",
}

# Filter constants and labels.
CERTIFIED = "Certified"
VISA_CLASS = "H-1B"
AUTO_ALIAS = "TRADE_NAME_DBA"
CURATED_ALIAS = "MANUAL_CURATED"

# The file a row came from decides which copy of a case wins, then the row's place in it.
FILE_ORDER = ("file_priority", "row_ordinal")


@dataclass(frozen=True)
class Semantic:
    """Settings of the vector layer."""

    threshold: float = 0.75
    fetch_k: int = 10
    tight_gap: float = 0.04
    ambiguous_margin: float = 0.10
    damping: float = 0.9
    rerank_window: int = 6
    floor_below_threshold: float = 0.05
    floor_below_runner_up: float = 0.02


@dataclass(frozen=True)
class Limits:
    """First-come limits per client: (window length, requests) pairs, tried in order."""

    windows: tuple[tuple[str, int], ...]


CHECK_LIMITS = Limits((("1 minute", 120), ("1 hour", 2000)))
SEARCH_LIMITS = Limits((("1 minute", 30), ("1 hour", 300)))


@dataclass(frozen=True)
class Listing:
    """Patterns and labels for listing text."""

    company_path: str = r"linkedin\.com/company/([^/?#]+)"
    unavailable_slug: str = "unavailable"
    label_yes: str = "✓ Sponsors H1B"
    label_no: str = "✗ Not Found"
    max_attempts: int = 8


@dataclass(frozen=True)
class Embedding:
    """Settings of the batch that fills missing vectors."""

    dim: int = 1536
    batch: int = 100
    usd_per_million_tokens: float = 0.02
    tokens_per_name: int = 5
