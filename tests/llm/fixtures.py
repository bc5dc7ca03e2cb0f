"""Small tables with nulls, empty and long texts, repeated rows, ties and columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("present", "score", "kept", "row", "group", "node", "id", "n_words", "label", "deal", "predicted")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ung"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (".\n" if i % 13 == 12 else "") for i, w in enumerate(words))


def edge_texts() -> list:
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        base,
        base,
        near,
        prose(2, 3000),
        "a " * 500,
        "Grüße, 東京 🎉   x\u0085y\x1cz <|endoftext|> it's 3½ ΑΣ İ",
        "Released under the MIT License. all rights reserved. Apache License, Version 2.0; CC BY-NC",
        "#|#|#" * 40,
    ]


def documents(spark, texts=None):
    texts = edge_texts() if texts is None else texts
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    if rows:
        rows += [rows[-1], (None, texts[-1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
