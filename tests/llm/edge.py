"""Documents with everything that may go wrong: null, empty and long texts, odd characters, copies, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rate double, spans string, score double, _key string, base string"
LONG = " ".join(f"Word{i % 977} und{i % 13}" for i in range(20_000))
STORY = "the quick brown fox jumps over the lazy dog and then runs away into the deep dark forest where nobody could ever find it again"


def documents(spark, more=(), repeat=True):
    texts = [
        (1, None, "s1"), (2, "", "s1"), (3, "  \t\n ", None), (4, LONG, "s2"), (5, STORY, "s2"), (6, STORY, "s2"), (7, STORY.upper() + "!", "é"), (8, STORY.replace("lazy", "sleepy"), "é"),
        (9, "mail a.b@c.de and +1 (386) 555-3733 or 25.86.162.211 and 4111 1111 1111 1111", None), (10, "one", "s3"), (11, "Ünï cödé ß 😀 𝄞 text\u0000with nul\x0b and vt sep", "s3"), (12, "!!! ??? ...", ""),
        (13, "!!! ??? ...", "Z"), *((i, t, "s9") for i, t in more),
    ]
    if repeat:
        texts += [texts[4], (None, STORY, "s1"), (None, None, None)]
    return spark.createDataFrame([(i, t, "en", s, 0, 7, 0.5, "x", 0.1, "k", "b") for i, t, s in texts], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
