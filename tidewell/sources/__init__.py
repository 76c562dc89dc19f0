"""Readers and writers that tolerate what pipelines leave behind."""
