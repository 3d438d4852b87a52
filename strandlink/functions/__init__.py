"""Part of strandlink."""
