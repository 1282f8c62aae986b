"""All registered queries and their SQL."""

from . import queries_analyses, queries_answers, queries_columns, queries_gaps, queries_models, queries_polls, queries_strata, queries_text, queries_weighting  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
