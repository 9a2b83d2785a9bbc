import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size long, fp long"
LONG = "lorem ipsum dolor sit amet " * 30_000


def rows():
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    texts = {
        1: "The quick brown fox jumps over the lazy dog and the cat",
        2: "The quick brown fox jumps over the lazy dog and the cat",
        3: "",
        4: None,
        5: " \t\n ",
        6: "Der schnelle braune Fuchs springt über den faulen Hund",
        7: LONG,
        8: "123 456 !!!",
        9: "El rápido zorro marrón salta sobre el perro perezoso",
        10: "Ünïcödé ΣΑΣ <|endoftext|> it's 9½ \x1c x y",
        11: "the the the the the the the the",
    }
    out = [(k, t, None if k == 9 else "de" if k == 6 else "en", None if k in (3, 9) else "ab"[k % 2], len(t or ""), -1, "x", 7, 0) for k, t in texts.items()]
    return out + [out[0], out[3], (None, "no id here", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
