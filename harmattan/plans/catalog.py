"""Imports every query module so that the registry is complete."""

from harmattan.plans import cleaning, engine, files, grids, kpis, landing, measures, streams, vectors  # noqa: F401

FLAGSHIP = "pivot_region_year"
