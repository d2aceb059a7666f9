"""Relational building blocks under stable names: each takes and returns DataFrames or columns."""

from __future__ import annotations

from tidewright.plans.audit import audit_band, chosen, describe, flags, report_band, salary_stats, skill_rows, skill_tokens
from tidewright.plans.base import record_numbers, tier
from tidewright.plans.ensembles import HuberBoosting, family_spaces
from tidewright.plans.evaluation import metrics, out_of_fold, outer_folds, rand_index
from tidewright.plans.relational import join_many_to_one
from tidewright.plans.serving import policy, validated

__all__ = ["HuberBoosting", "audit_band", "chosen", "describe", "family_spaces", "flags", "join_many_to_one", "metrics", "out_of_fold", "outer_folds", "policy", "rand_index", "record_numbers", "report_band", "salary_stats", "skill_rows", "skill_tokens", "tier", "validated"]
