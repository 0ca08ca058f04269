"""The file parsers over growing folders."""
