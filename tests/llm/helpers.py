"""Small tables and plain references for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs)], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]
