"""Part of larkspur: plans."""
