"""Rows that every operator must take."""

EDGE = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one two three"),
    (5, "One TWO three"),
    (6, "a b c d e f g h i j k l m n o p"),
    (7, "a b c d e f g h i j k l m n o p"),
    (7, "a b c d e f g h i j k l m n o p"),
    (8, "word " * 30_000),
    (9, "é" * 5_000 + " ünï çödé 日本語 🙂"),
    (10, "x" * 70_000),
    (None, "a document without an id but with words"),
    (12, "line\nline\nline\nother <|endoftext|> text here"),
]
