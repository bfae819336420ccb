"""Spark-first engine for multimodal sample preparation and sequence packing."""
