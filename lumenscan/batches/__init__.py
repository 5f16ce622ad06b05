"""Whole files as arrays: what windows over the lexemes of a file say, for a batch of files at a time."""
