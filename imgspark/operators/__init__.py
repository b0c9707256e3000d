"""Operators over manifests, results, progress, rasters and edits."""
