"""Small tables with the cases that every operator must survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, words int, n int"
LONG = "lorem ipsum dolor " * 4000


def documents(spark, rows=None):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    if rows is None:
        rows = [
            (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, "x", 1, 1),
            (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, None, None, None),
            (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, None, None, None),
            (3, None, "en", None, None, "y", 2, 2),
            (4, "", None, "b", 0, "y", 2, 2),
            (None, "no id here at all but some words to read in this line", "en", "b", 1, "z", 3, 3),
            (5, LONG, "en", "b", 9, "z", 3, 3),
            (6, "   \t\n ", "fr", "c", 7, "z", 3, 3),
            (7, "ÉTÉ à la maison\nÉTÉ à la maison\n été", "fr", "c", 7, "z", 3, 3),
            (8, "x", "fr", "c", 7, "z", 3, 3),
            (9, "One Two Three Four five six seven eight nine ten eleven twelve", None, "a", 5, "x", 1, 1),
        ]
    return spark.createDataFrame(rows, DOCS)


def texts(path, *columns):
    import pyarrow.parquet as pq

    return pq.read_table(path).select(list(columns)).to_pylist()


SF = "/root/testdata/sf0.001"
