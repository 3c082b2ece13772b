"""Candidate sources, saved searches, snapshots and sinks."""
