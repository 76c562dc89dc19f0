"""Registered queries, each with its SQL, by theme."""

from tidewell.plans import drift, etl, ingest, joins, more, quality, snapshots, stats, streams, texts

MODULES = [snapshots, etl, joins, stats, more, streams, drift, quality, texts, ingest]
