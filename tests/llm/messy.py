"""A small table with everything that operators must bear."""

import random

WORDS = "the of and to in is that for it was on are as with his they at be this from".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    made = (rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 8))) for _ in range(n))
    return " ".join(made).capitalize() + "."


LONG = "\n".join(prose(400, i) for i in range(60))
ROWS = [
    (1, prose(120, 1)),
    (2, None),
    (3, ""),
    (4, " \n\t \x0b "),
    (5, LONG),
    (6, prose(120, 1)),
    (1, prose(120, 1)),
    (None, "A row without an id, with some words in it."),
    (7, "ünï あ漢字 𝒳 😀 é ÀÉ\x00\x1c end"),
    (8, "a"),
    (9, "\\### Assistant: </turn> <turn:user>\n"),
    (10, "The The The " * 60),
]


def messy(spark):
    """doc_id, text and columns named like every operator's results."""
    rows = [(i, t, "x", 1, "src", True, "s") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_chars long, source string, kept boolean, spans string")


def empty(spark):
    return messy(spark).where("1 = 0")


def corpus(spark, n: int = 240):
    """Documents and labels: symbols and repeats are bad, slurs toxic."""
    docs, labels = [], []
    for i in range(n):
        text = prose(80 + i % 50, 1000 + i)
        bad, toxic = i % 6 == 5, i % 8 == 3
        if toxic:
            words = text.split()
            for k in range(3, len(words), 15):
                words[k] = ("grolk", "splatz", "vurmish" + words[k][:3])[k % 3]
            text = " ".join(words)
        if bad:
            text = " ".join(w + "***" for w in text.split()) if i % 2 else " | ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n + k, t, "en", None, None) for k, (_, t) in enumerate(ROWS)]
    labels += [(n, None, None), (None, 1, 0), (n + 1, 1, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
