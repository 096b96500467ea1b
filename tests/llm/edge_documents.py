"""Documents with every odd case at once, with columns whose names clash with those the operators use."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = "Word after word, number 12345 and more; " * 3000
TEXTS = [None, "", " \t\n", "one", "one two three", "The same text twice over, word for word and no less.", "The same text twice over, word for word and no less.",
         "¡Ñandú! Ångström straße über naïve façade — 你好 世界 🙂🙂", "'re' 've'll 'r  \n\n  x's   ", "a" * 5000, LONG, "0" * 400, "+" * 300, "@" * 300 + "a@b.c", "%%%20%zz\\u00", "1.2.3.4.5.6.7.8"]
NAMES = ("k", "t", "text", "score", "row", "node", "root", "id", "_mix", "mix_pass", "__text", "labels", "spans", "part",
         "__id", "__place", "__root", "__key", "__set_key", "__lang", "__score", "mix_x", "__mix_x")
SCHEMA = StructType([StructField("doc_id", LongType()), *[StructField(n, StringType()) for n in NAMES], StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def edge_documents(spark):
    rows = []
    for i, t in enumerate(TEXTS):
        row = {n: f"{n}{i}" for n in NAMES} | {"doc_id": None if i == 7 else i, "text": t, "lang": (None, "en", "de")[i % 3], "source": (None, "s", "s", "t")[i % 4], "n_chars": None if t is None else len(t)}
        rows += [tuple(row[f.name] for f in SCHEMA)] * (2 if i in (4, 5, 7) else 1)
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
