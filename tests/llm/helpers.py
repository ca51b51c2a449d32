"""Small document tables with the cases every operator must stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def frame(spark, texts, first=0, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(first + i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    long_text = "alpha beta gamma delta. \n" * 4000 + "é😀 x" * 50
    rows = [
        (1, "plain words here and there", "en", "a", 26), (1, "plain words here and there", "en", "a", 26), (1, "other text of the same id", "en", "a", 25),
        (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no id at all", "en", "b", 12), (None, None, None, None, None),
        (4, long_text, "en", "b", len(long_text)), (5, " \t\n ", "en", None, 4), (6, "é😀 ß", "de", "c", 4), (7, "x", "en", "c", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Further columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("rid", "row", "words", "n_words", "size", "key", "kind", "start", "end", "spans", "found", "text_", "fingerprint", "component_id", "n", "v", "h", "score", "label", "chunk", "rate", "source_size")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def write(df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
