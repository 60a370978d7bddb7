"""Spark jobs for metered-usage and payment fact tables: ingest, typing, quality, analytics."""

from gridtally.spec import CONSUMPTION, VEND, DatasetSpec, DatePolicy, Thresholds

__all__ = ["CONSUMPTION", "VEND", "DatasetSpec", "DatePolicy", "Thresholds"]
