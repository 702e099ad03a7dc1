"""Imports every plan module so that the registry is complete."""

from peakloom.plans import basics, format_plans, graph_plans, hit_plans, learning_plans, peak_plans, stat_plans, text_plans  # noqa: F401
from peakloom.plans.registry import REGISTRY, spark_callable  # noqa: F401
