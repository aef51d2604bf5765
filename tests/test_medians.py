import random
from statistics import median

from leafloom.operators import medians


def test_medians_of_all_kinds_of_groups(spark):
    rnd = random.Random(5)
    groups = {
        "one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 500, "skewed": [0.0] * 300 + [1e300, -1e300], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(333)], "near": [1.0 + k * 2**-52 for k in range(101)],
        None: [rnd.gauss(0, 1) for _ in range(400)], "even": [rnd.randint(0, 9) * 1.0 for _ in range(200)], "ends": [-1.7e308, 1.7e308, 0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    for pieces in (256, 4096):
        got = {r.g: (r.n, r.median) for r in medians.exact_medians(df, ["g"], "v", pieces).collect()}
        assert got == {g: (len(vs), median(vs)) for g, vs in groups.items()}, pieces
    assert medians.exact_medians(df.where("false"), ["g"], "v").count() == 0
