"""Encoders, scores, feature analysis, evaluation and learners: DataFrame in, DataFrame out."""
