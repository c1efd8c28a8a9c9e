"""Schemas of the library's tables and of the JSON that analysis phases store."""

from __future__ import annotations

PAPERS = "id long, title string, authors string, year int, journal string, doi string, domain string, agent_used string, folder_name string, tags string, status string, analyzed_at timestamp_ntz, notes string, created_at timestamp_ntz"
RESULTS = "id long, paper_id long, phase string, result string, model_used string, tokens_in long, tokens_out long, cost_usd double, created_at timestamp_ntz"
FIGURES = "id long, paper_id long, figure_num string, caption string, file_path string, ai_analysis string, quality string, detailed_explanation string"
SETTINGS = "key string, value string, updated_at timestamp_ntz"
CAPTION = "title string, sub_captions array<struct<label: string, text: string, references: array<string>>>, references array<struct<text: string, page_number: int, figure_label: string>>"
RECIPE = "title string, objective string, materials array<string>, equipment array<string>, parameters array<struct<name: string, value: string, unit: string, notes: string>>, steps array<string>, critical_notes array<string>, confidence double"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"

# Names that stored rows hold.
MAIN_PHASES = ["screening", "visual", "recipe", "deep_dive"]
VIZ_PHASES = ["viz_plan", "visualization"]
ERROR_PHASE = "error"
SORTABLE = ["created_at", "title", "year", "status", "domain", "analyzed_at"]
DEFAULT_SETTINGS = {"language": "en", "theme": "light", "auto_analyze": "true", "monthly_budget_limit": "50.0"}
