"""Operators on DataFrames: retrieval, metrics, corpus preparation, evidence, planning, audits."""
