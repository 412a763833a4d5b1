"""Awkward documents, and a plain reading of the documents table."""



def thue_morse(n):
    """A word of n letters and its complement: polynomial hashes modulo a power of two take them for the same."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SHORT, LONG = thue_morse(1024), thue_morse(2048)
AWKWARD = [
    (1, "", "x"),
    (2, None, "x"),
    (3, " \n\t ", None),
    (4, "one two", "x"),
    (4, "one two", "x"),
    (None, "a b c d e f g", "x"),
    (5, "It's we'll ’s  don't  \n\n x  é中文 👍 <|endoftext|> end", "x"),
    (6, "w" * 3000, "x"),
    (7, "ab cd. " * 4000, "x"),
    (8, "ONE Two", "x"),
    *((9 + k, word, "x") for k, word in enumerate((*SHORT, *LONG))),
    (13, "\n".join((*SHORT, *LONG)), "x"),
    (14, " ".join([*SHORT] * 4), "x"),
]
COLUMNS = "doc_id long, text string, lang string"


def awkward(spark):
    """Extra columns bear names that operators use themselves."""
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in AWKWARD], COLUMNS + ", id string, key string, n_tokens int, ids string")


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(spark, sf, name="documents"):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id", "text").collect()}
