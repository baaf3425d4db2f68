import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size long, target string, spans string, h int, source_size string, anchor string, m string, n string, `a.b` string, __k string, __did string, __thash string, row string, taken int, path string"


def words(seed, n, vocabulary=2000):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) + str(rnd.randrange(vocabulary)) for _ in range(n))


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    shared = words(1, 60)
    long = words(2, 60_000)
    rows = [
        (1, "", "en", "a"), (2, None, None, "a"), (3, "Hello, World! write to me@x.org or +1 (743) 555-3824", "en", None), (3, "Hello, World! write to me@x.org or +1 (743) 555-3824", "en", None),
        (None, shared + " null id", "en", "b"), (None, shared + " null id", "en", "b"), (5, long, "de", "b"), (6, long + " tail", "de", "c"), (7, shared + " one", None, "c"), (8, "two " + shared, "fr", "c"),
        (9, "\n\t \n", "en", "c"), (10, "éÉ ßẞ ñ 漢字 💡 \u0085  x", "es", "é"), (11, "12345 !!! ???", "en", "a"), (12, long, "de", "b"), (7, "same id, other text", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2, "t", "s", 3, "z", "a", "m", "n", "dot", "k", "own id", "own hash", "r", 5, "p") for r in rows], SCHEMA)


def no_documents(spark):
    return odd_documents(spark).where("false")


def collected(df):
    return [r.asDict() for r in df.collect()]


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def same_rows(a, b):
    key = lambda r: str(sorted(r.items(), key=str))
    return sorted(map(key, a)) == sorted(map(key, b))


def as_long(df, column):
    return df.select(F.col(column).cast("long")).collect()
