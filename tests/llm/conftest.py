import random

import pytest

WORDS = {"en": "the of and to in is that it was for on with as be at by this from or have an they which one you were all".split(), "fr": "le la les des un une et est que qui dans pour par sur pas plus avec son sa ses être été où".split(), "de": "der die das und ist nicht ein eine mit auf für von dem den über sich auch werden größe".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "s", "on"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Documents with nulls, empty and very long texts, ties, repeated rows, odd characters and near copies: (doc_id, text, lang, source)."""
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, rng.randint(5, 120)) + "\n" + prose(rng, lang, 12), lang, f"src{i % 3}") for i, lang in enumerate(["en", "fr", "de"] * 20)]
    base = prose(rng, "en", 300)
    words = base.split()
    for k in range(12):
        own = list(words)
        for _ in range(k):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(own), "en", "src0"))
    rows += [(200, None, "en", "src0"), (201, "", "en", None), (202, " \t\n ", None, "src1"), (203, "123 456 !!", "en", "src1"), (None, prose(rng, "en", 30), "en", "src1"), (None, None, None, None)]
    rows += [(204, rows[0][1], "en", "src0"), (205, rows[0][1], "en", "src0"), rows[1], rows[1]]
    rows += [(206, "one two three", "en", "src0"), (207, "one two three", "en", "src2"), (208, "a\u0085b c\x1cd İstanbul ΣΑΣ é 日本語 😀 <|endoftext|> </turn>", "en", "src0")]
    rows += [(209, prose(rng, "de", 20_000), "de", "src0"), (210, "line that many documents share\n" * 5 + "own", "en", "src0")]
    rows += [(211 + k, f"Line That many documents SHARE \nsomething {k}\r\n\n", "en", "src0") for k in range(4)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, "doc_id bigint, text string, lang string, source string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
