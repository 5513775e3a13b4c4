"""Query plans composed of the operators, and their registry."""

from tallyforge.plans import catalogue_data, catalogue_facts, catalogue_more, catalogue_ratios, catalogue_results, catalogue_structure, catalogue_tasks  # noqa: F401
from tallyforge.plans.catalogue import FOUND as ALL

__all__ = ["ALL"]
