"""Operators of a training-data pipeline: media columns, mixing, web archives,
quality rules, language-model scores, surrogate data, tokenisation, record files,
toxicity and near duplicates.  Nothing else in the library imports this package."""
