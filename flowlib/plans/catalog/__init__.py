"""Checked queries by area; importing this package fills the registry."""

from flowlib.plans.catalog import arrivals, cleaning, labels, latency, models, quality, reports, splits, streams  # noqa: F401
