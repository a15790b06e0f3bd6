"""Registered queries of the voxel, lesion, prediction and run operators, with their SQL."""

from __future__ import annotations

from voxtab.plans import queries_anatomy, queries_decisions, queries_graphs, queries_learning, queries_lesions, queries_necks, queries_priors, queries_runs, queries_trees, queries_voxels  # noqa: F401
from voxtab.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
