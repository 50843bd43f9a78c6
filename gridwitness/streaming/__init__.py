"""Structured Streaming: bundles into a ledger, and the stateful operators of capture."""
