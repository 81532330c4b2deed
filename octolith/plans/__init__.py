"""Pipelines: named ways to build a tree and to answer a view."""
