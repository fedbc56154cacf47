"""Readers, landed-payload normalisers, the feature store and sinks."""
