import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", " \t\n", "one two three four five six", "one  two three\nfour five six", "One two three four five six", "x" * 50_000, long, "é ü ß", "a b"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 27), (None, texts[3], None, None, None), (None, None, None, None, None), (11, "a b", None, None, None)]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    for name in ("row", "hash", "key", "size", "class", "score", "normal", "bucket", "label", "meta_n_chars", "__key", "edge"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return frame(spark, [])


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
