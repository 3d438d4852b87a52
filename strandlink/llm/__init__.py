"""Operators for preparing training corpora: fingerprints, mixing, extraction,
personal data, quality, near duplicates, language identification, tokenisation,
fill-in-middle, importance resampling, repeated lines.

Nothing outside this subpackage imports it.
"""
