"""Readers and writers of the sequence and feature formats, and adapters to the driver's tables."""
