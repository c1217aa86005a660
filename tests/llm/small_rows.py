"""Rows with every odd case, for the tests of this folder."""

LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30000))
BASE = " ".join(f"word{i}" for i in range(100))
#: (doc_id, text, lang, source): null and empty texts, copies, near copies, ties, a repeated row, a very long text, a null id.
ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, "One two", "en", "b"), (5, "One  two", "de", "b"),
    (6, BASE, "en", "b"), (7, BASE.replace("word50", "other"), "en", "c"), (8, BASE, "de", "c"), (8, BASE, "de", "c"), (9, LONG, "en", "a"),
    (10, "é " * 60, "fr", "a"), (11, "a!! b!! c!!\na!! b!! c!!\n" * 20, "en", None), (12, "x " * 15 + BASE, "en", "d"), (None, "no id here " * 20, "en", "d"), (13, "| 1 | 2 | # % $ " * 20, "de", "e"),
]
