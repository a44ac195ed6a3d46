"""Operands beyond columns and aggregates."""
