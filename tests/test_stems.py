from pyspark.sql import functions as F

from leafloom.functions import evidence


def plain(word):
    low = word.lower().strip("'’-")
    low = low[:-2] if low.endswith(("'s", "’s")) else low
    if any(c.isdigit() for c in low):
        return low.replace(",", "")
    return next((low[: -len(s)] for s in evidence.SUFFIXES if low.endswith(s) and len(low) - len(s) >= 4), low)[:5]


def test_stems_are_those_of_the_first_ending_that_fits(spark):
    words = [f"{'abcdefgh'[:n]}{s}" for n in range(1, 9) for s in ("", *evidence.SUFFIXES, "x")] + ["Cat's", "-Dogs'-", "don’t", "o'neill’s", "12th", "A1s", "re-tested"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", evidence.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: plain(w) for w in words}
