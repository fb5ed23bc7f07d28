"""Rows that every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, b int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def documents(spark):
    texts = [None, "", " \n\t ", "one", "one two three", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "the cat sat on the mat the cat sat on the mat the cat sat on the mat", LONG, LONG + " end", "éè \U0001f600 café " * 20, "x" * 5000, "line one here\nline one here\n\nline two here\n" * 3, "mail a.b+c@d-e.example.org, 10.0.0.255 or +1 (555) 010-9999 and 4111 1111 1111 1111."]
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or ""), 0.5, "x", i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "null id text with some words to look at here now and then", None, "", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows=((5, 1, 0), (6, 1, 0), (8, 0, 1), (8, 0, 1), (None, 1, None), (13, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
