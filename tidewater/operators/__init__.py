"""Logical plans as DataFrames, table changes, index reads, live deltas, builders."""
