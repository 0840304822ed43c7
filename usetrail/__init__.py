"""Lifecycle and concurrency-hazard analytics over tables of occurrences."""
