"""Limits of the Arrow batches that operators on long texts work on."""

from auditmill.session import BATCH_LIMITS, bound_batches

__all__ = ["BATCH_LIMITS", "bound_batches"]
