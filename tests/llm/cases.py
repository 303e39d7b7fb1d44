"""Awkward documents that every operator on documents has to stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("size", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("hits", T.IntegerType()),
        T.StructField("__t", T.IntegerType()),
    ]
)


def rows(texts, sources=("a", "b", None)):
    return [(k, t, "en", sources[k % len(sources)], None if t is None else len(t), "x", "y", 1, 2, 3) for k, t in enumerate(texts)]


def awkward():
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "z " * 40, "dup line\ndup line\n\n  \nother", long, long, "é ü ñ 漢字 \U0001f600 tail", "\x85 nbsp joined x"]
    out = rows(texts)
    out.append(out[5])  # a repeated row
    out.append((None, "no id at all " * 5, None, None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(awkward() if data is None else data, SCHEMA)
