"""Batches: state that is merged batch by batch."""
