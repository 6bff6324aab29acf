"""Binned maps that grow with a stream of samples."""
