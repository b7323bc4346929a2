"""Rows for the edge cases."""

#: Nulls, empty and blank texts, ties, repeated rows, special strings, odd blanks and one long text.
EDGE = [
    (None, None, None, None), (1, "", "en", "a"), (2, "  \n ", None, "a"), (2, "  \n ", None, "a"), (3, "one", "en", None),
    (3, "one two three", "en", "a"), (4, "x  y   z \n\n w \t \n v  u   t", "en", "a"), (5, "a<|endoftext|>b <|startoftext|> c", "de", "b"),
    (6, "ein längeres Wort und noch eins für die Probe der Sprache " * 30, "de", "b"), (7, "\0 null \0byte", "en", "b"),
    (8, "word " * 30_000, "en", "b"), (None, "no id here at all but some words to keep", "en", "b"), (9, "12345 678 !!! ???", "en", "c"),
    (10, "́ combining \x1c control\x1fsplit İstanbul ǅ ß", "fr", "c"), (-5, "tail \n", "fr", "c"),
]
