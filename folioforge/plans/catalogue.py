"""Imports every module that registers queries."""

from folioforge.plans import q_cost, q_library, q_models, q_reports, q_runs, q_search, q_text  # noqa: F401
