"""Rows that every operator has to live with."""

EDGES = [(901, None), (902, ""), (903, " \n\t "), (904, "same text twice, same text twice"), (905, "same text twice, same text twice"), (906, "日本語 😀 text"), (907, "x" * 30_000), (908, "word " * 30_000)]


def documents(spark, rows, extra=True):
    """(doc_id, text) with columns whose names operators might use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(i, t, "en", "src", len(t or ""), "k") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


def saved(tmp_path, df, table="documents"):
    df.coalesce(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)
