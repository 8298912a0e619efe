"""A small table with every awkward row, and ways to read results."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size double, part string"
EXTRA = (7, "x", 1.5, "p")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def table(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang, source); further columns have names that operators use inside."""
    full = [(*r, *((None, None) if len(r) == 2 else ()), 0, *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "The Cat sat on the mat today."),
    (2, "the cat SAT on the mat today."),
    (2, "the cat SAT on the mat today."),
    (3, None),
    (4, ""),
    (5, "   \t\n"),
    (None, "The Cat sat on the mat today."),
    (6, "É É é"),
    (7, "é é é"),
    (8, LONG),
    (9, LONG + " end"),
    (10, "one"),
    (11, "#$%& 1234 !!!"),
    (None, None),
]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
