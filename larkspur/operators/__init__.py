"""Part of larkspur: operators."""
