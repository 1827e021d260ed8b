"""Spark-first engine for levelled-reading content: sources, text operators, quality gates and learner state."""
