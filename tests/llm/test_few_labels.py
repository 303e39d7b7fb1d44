import numpy as np

from pagegauge.llm import toxicity


def test_few_labels_choose_telling_words():
    """Words in four of 11 positive rows of 86, and in no other, are chosen, and next to nothing else."""
    rng = np.random.default_rng(2)
    y = np.arange(86) % 8 == 0
    rows = [np.unique(np.concatenate([rng.integers(1000, 9000, 40), [[7], [11], [13]][k // 8 % 3] if t else []]).astype(np.int64)) for k, t in enumerate(y)]
    chain = toxicity.train(rows, {"toxic": y})
    assert {7, 11, 13} <= set(chain.links[0].slots.tolist())
    assert len(chain.links[0].slots) <= 5


def test_insults_are_caught_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    words = "idiot|moron|clown|loser|scum|trash|pathetic|worthless|disgusting|stupid"
    rows = toxicity.report(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    toxic = [r["rejected"] for r in rows.where(f"toxic = 1 and lower(text) rlike '{words}'").collect()]
    assert len(toxic) > 5 and sum(toxic) >= 0.7 * len(toxic)


def test_the_chain_beats_a_single_model_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows, y = toxicity.sample(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))

    def held_out(categories):
        p = np.zeros(len(rows))
        for f in range(3):
            held = np.arange(len(rows)) % 3 == f
            some = [rows[k] for k in np.flatnonzero(~held)]
            chain = toxicity.train(some, {**categories(some, y[~held]), toxicity.LAST: y[~held]})
            for k in np.flatnonzero(held):
                before = []
                for x in chain.links:
                    before.append(1 / (1 + np.exp(-(x.weights[np.isin(x.slots, rows[k])].sum() + x.bias + np.dot(before, x.earlier)))))
                p[k] = before[-1]
        return (p[y] >= toxicity.THRESHOLD).mean(), -np.log(np.where(y, p, 1 - p).clip(1e-6)).mean()

    (caught, loss), (caught_1, loss_1) = held_out(toxicity.kinds), held_out(lambda r, t: {})
    assert caught >= caught_1 and loss < loss_1
