"""Small tables for the operators: written as Parquet, with extra columns whose names clash with inner ones."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, score double, token string"
SCHEMAS = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, token long",
    "pages": "page_id long, url string, html string, digest string",
    "embeddings": "vec_id long, embedding array<float>, label int, uid long",
}


def put(spark, folder, **rows):
    """Write every table of SCHEMAS (empty where no rows are given) and return the folder. Rows may be shorter than the schema."""
    for name, schema in SCHEMAS.items():
        width = schema.count(",") + 1
        full = [(*r, *[None] * (width - len(r))) for r in rows.get(name, [])]
        spark.createDataFrame(full, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(texts, source="web"):
    return [(i, t, "en", source if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
