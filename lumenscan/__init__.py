"""Source-code analytics on Spark DataFrames."""

LEXER_VERSION = "1"
