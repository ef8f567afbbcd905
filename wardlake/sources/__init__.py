"""Readers and writers: bundles, table folders, lists, run log."""
