"""Which files are read."""

from __future__ import annotations

import os

TRIPLE_SUFFIXES = {".ttl": "turtle", ".nt": "ntriples", ".rdf": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml"}
#: Syntaxes of several named graphs; a module is one graph, so these are refused.
DATASET_SUFFIXES = (".trig", ".nq")


def syntax(path: str) -> str | None:
    """turtle, ntriples or rdfxml, None if the suffix says nothing; named-graph syntaxes are an error."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in DATASET_SUFFIXES:
        raise ValueError(f"a file of named graphs cannot be a module: {path}")
    return TRIPLE_SUFFIXES.get(suffix)


def discover(inputs: list[str]) -> list[str]:
    """Absolute, distinct, sorted files: those named, and all triple files below directories."""
    found = set()
    for given in inputs:
        path = os.path.abspath(given)
        if os.path.isdir(path):
            for folder, _, names in os.walk(path):
                found |= {p for n in names if syntax(p := os.path.join(folder, n))}
        elif not os.path.exists(path):
            raise FileNotFoundError(f"no such input: {path}")
        elif syntax(path) is None:
            raise ValueError(f"not a file of triples: {path}")
        else:
            found.add(path)
    return sorted(found)


def required(directory: str) -> list[str]:
    """discover() of a directory that must be there and hold triples."""
    if not os.path.isdir(directory):
        raise FileNotFoundError(f"no such directory: {directory}")
    files = discover([directory])
    if not files:
        raise ValueError(f"no triples in {directory}")
    return files


def module_name(path: str, root: str) -> str:
    """The root-relative path with / (the absolute path outside the root)."""
    path, root = os.path.abspath(path), os.path.abspath(root)
    inside = os.path.commonpath([path, root]) == root
    return (os.path.relpath(path, root) if inside else path).replace(os.sep, "/")
