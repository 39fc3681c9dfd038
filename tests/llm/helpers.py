import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, runs string, w_id string, parts string, score double, anchor string"


def docs_frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "r", "w", "p", 0.5, "a") for i, t in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}x{'yz' * rng.randrange(3)}" for _ in range(n))


def odd_rows(seed=1):
    """Null ids and texts, empty and blank texts, a very long text, ties, repeated rows, shared passages, near copies."""
    rng = random.Random(seed)
    passage = words(rng, 120)
    short = words(rng, 60)
    periodic = "spam " * 300
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, words(rng, 6000))]
    rows += [(10 + k, f"{words(rng, rng.randrange(5, 80))}\n{passage} {words(rng, rng.randrange(5, 80))}") for k in range(12)]
    rows += [(30 + k, f"{words(rng, 30)} {short}\n{words(rng, 3)}") for k in range(5)]
    same = words(rng, 90)
    rows += [(40, same), (41, same), (42, same), (42, same), (43, same + " end"), (44, "start " + same)]
    rows += [(50, periodic), (51, "spam " * 299), (52, periodic + "é日本🎉 " * 70), (None, same), (None, None)]
    rows += [(60, "é日本🎉" * 120), (61, "x" + "é日本🎉" * 110), (70, same + same), (71, words(rng, 49)), (72, words(rng, 50))]
    return rows
