"""Readers: files of triples, relational tables as triples, manifests, baselines."""
