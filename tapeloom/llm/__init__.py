"""Operators and queries for preparing large text corpora for language-model training."""
