"""Readers and writers: report files, tables, batches with a manifest, run history."""
