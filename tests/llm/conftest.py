import random

import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, bitmap string, shard string, id string, h1 string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "é", "on", "th", "ing", "Ab", "7"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", "!?"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    texts = [
        None, "", " ", "\n", "\n\n", "a", "the the the the the", base, base, base + " tail", " " + base, "  lead  and  double ", "tabs\tand\x0bothers\x0c\r\n", "non break   wide　end",
        "x" * 30_000, "é à ü ß 日本語 テキスト", "don't can't we'll 's 't it's.", "a.b,c d. e , f", "<|endoftext|> inside <|startoftext|>", "1234567890 12 3 4.5", "﻿mark é combining", "emoji 😀 mixed 😀😀", "end space ", "line one\nline two\nline one\n", "\x00nul\x1c sep",
        "pipe | pipe || | end", "A" * 5 + "\n" + " b", "×÷ ×. ÷,", "one, two,\nthree. four",
    ]
    texts += [sentence(rng, rng.randint(1, 400)) for _ in range(25)]
    texts += ["\n".join(sentence(rng, 12) for _ in range(20)) for _ in range(4)]
    texts.append(" ".join(sentence(rng, 3) for _ in range(4000)))
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", None if i % 5 == 0 else f"src{i % 4}", None if t is None else len(t), "b", "s", "i", None) for i, t in enumerate(odd_texts)]
    rows += [rows[7], rows[7], (None, odd_texts[7], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ROWS)
