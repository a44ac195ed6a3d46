"""Expressions and queries: what users build."""
