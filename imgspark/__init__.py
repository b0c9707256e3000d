"""Spark jobs that prepare large image collections: manifests, pixel kernels, crop plans, selections, edits, progress."""
