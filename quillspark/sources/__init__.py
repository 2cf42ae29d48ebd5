"""Readers: containers to streams, streams to records, records to typed tables."""
