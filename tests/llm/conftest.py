import pytest
from hypothesis import settings

settings.register_profile("few", max_examples=25, deadline=None)
settings.load_profile("few")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "ab cd " * 30_000 + "x" * 70_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"), (2, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"), (3, None, "en", "s1"), (4, "", None, "s2"), (5, "   \n\t ", "en", None),
        (6, long, "en", "s2"), (7, "123 !!! 456", None, None), (8, "der schnelle braune Fuchs springt über den faulen Hund und läuft", "de", "s1"), (8, "der schnelle braune Fuchs springt über den faulen Hund und läuft", "de", "s1"),
        (9, "日本語の文章です。\U0001f600 it's we'll I'Ve", None, "s2"), (None, "no id here at all", "en", "s1"), (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], DOCS)
    clash = ["size", "score", "n_tokens", "shard", "rule", "png", "h", "id", "taken", "component_id", "lang_pred", "_t", "run", "_text", "row", "_row", "key", "one", "_one", "_k_id", "turn", "rank", "pass", "spans", "cross_entropy", "rejected", "bits", "start"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in clash}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    from pyspark.sql import functions as F

    return odd.filter(F.lit(False))


@pytest.fixture(scope="session")
def corpus(spark):
    """A small generated corpus in two invented languages, with copies, near copies and insults."""
    import random

    rng = random.Random(7)
    words = {"en": ["the", "and", "ring", "thing", "wood", "light", "house", "river", "stone", "walk"], "de": ["der", "und", "zeit", "schnell", "wald", "licht", "haus", "fluss", "stein", "gang"]}
    rows = []
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en", "ly"]) for _ in range(rng.randint(20, 90)))
        if i % 6 == 1:
            text += " you stupid worthless idiot"
        rows.append((i, text, lang, f"s{i % 4}"))
    for i in range(240, 300):
        text = rows[i - 240][1].split(" ")
        if i % 2:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), rows[i - 240][2], "s0"))
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], DOCS).cache()
