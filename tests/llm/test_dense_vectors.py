import numpy as np

from leafloom.llm.embed_dedup import near_duplicate_vectors


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_pairs_in_a_dense_topic(spark):
    """Pairs at cosine 0.951 among rows at 0.88 to each other, with a window that the topic overfills."""
    rnd, dim = np.random.default_rng(1), 64
    topic = unit(rnd.standard_normal(dim))
    def apart(towards):
        y = rnd.standard_normal(towards.shape)
        return unit(y - (y * towards).sum(axis=1, keepdims=True) * towards)
    base = np.repeat(topic[None], 3000, axis=0)
    x = np.sqrt(0.88) * base + np.sqrt(0.12) * apart(base)
    mates = 0.951 * x[:200] + np.sqrt(1 - 0.951**2) * apart(x[:200])
    every = unit(np.concatenate([x, mates]))
    c = np.triu(every @ every.T >= 0.95, 1)
    label = np.arange(len(every))
    for i, j in zip(*np.nonzero(c)):
        label[label == label[j]] = label[i] if label[i] < label[j] else label[j]
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    links = (c | c.T).sum(axis=1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, window=4).collect()}
    assert [k for k in got if got[k] != links[k]] == []
