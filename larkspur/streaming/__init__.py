"""Part of larkspur: streaming."""
