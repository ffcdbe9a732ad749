"""Rows that every operator must handle: null, empty, blank, short, repeated, very long, beyond ASCII."""

ODD = [None, "", " \n\t", "a", "a", "one two", "é ü ß 中文", "word " * 30_000, "x" * 50_000, "word " * 30_000]
