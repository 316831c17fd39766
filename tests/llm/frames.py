"""Small documents with every awkward case, and the edge rows all operators are tried on."""

PROSE = ("The river ran past the old mill and the children who lived there counted boats until the evening light was "
         "gone and somebody called them in for supper with the others from the hill")


def documents(spark, texts, extra=True):
    """Rows (doc_id, text) plus columns whose names clash with what operators make."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("key", "words", "hash", "fp", "spans", "score", "n_words", "host", "label", "piece", "rows"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


EDGES = [None, "", "   \n\t ", "one", "two words", PROSE, PROSE, "naïve Ünïcode 日本語 😀 text", "a " * 3000, "#" * 500]
