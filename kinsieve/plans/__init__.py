"""Helpers that steer physical plans, and whole audits built from operators."""
