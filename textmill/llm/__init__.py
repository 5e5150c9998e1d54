"""Operators of a training-data pipeline: language identification, packing,
near-duplicates, personal data, quality, url judgement, line removal, main
text of pages, vector search and byte-level tokens. Nothing outside this
subpackage imports it."""
