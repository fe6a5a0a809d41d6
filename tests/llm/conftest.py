import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {lang: [f"{stem}{k}" for stem in stems for k in "abcdefghij"] for lang, stems in {"en": ("thor", "ing", "wha"), "de": ("schu", "ung", "keit"), "fr": ("eau", "ment", "tre")}.items()}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(("", "en", "st", "a")) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows of (doc_id, text, lang, source, n_chars) with copies, near copies, odd rows and long texts."""
    rng = random.Random(3)
    rows = []
    for k in range(120):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, "\n".join(prose(rng, rng.randint(9, 40), lang) for _ in range(rng.randint(1, 5))), lang, f"src{k % 4}"))
    for k in range(40):  # near copies and copies
        words = rows[k % 5][1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + k, " ".join(words), "en", "src0"))
    rows += [(300, "", "en", "src1"), (301, None, None, None), (302, "one two", "en", None), (303, "one two", None, "src2"), (304, "# 12 !", "en", "src2")]
    rows.append((305, prose(rng, 20_000), "en", "src3"))
    rows += [rows[7], (None, "a text without a number for its name", "en", "src1")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("h", "n", "key", "token", "first", "line", "score", "rep", "start", "_word", "_hit", "removed2", "p", "weight", "topic", "id", "item_id")
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
