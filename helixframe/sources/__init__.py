"""Readers and writers of native text formats."""
