import math
import random

from pyspark.sql import functions as F

from pagegauge.llm import urls


def pages(spark, addresses):
    return spark.createDataFrame([(k, u) for k, u in enumerate(addresses)], "page_id long, url string")


def test_tables_are_the_models_of_all_addresses(spark):
    """Every address is counted whatever the threshold's sample, and ratios are those of the plain models."""
    good = [f"http://{a}{b}.example.org" for a in ("thing", "tion", "é\U0001f600r", "weather") for b in ("ing", "er", "est", "x9", "on", "ly")]
    bad = [f"http://casino-{a}{k}.example.org" for a in ("win", "lucky", "q") for k in range(8)]
    model = urls.fit(pages(spark, good + bad + good), sample_urls=3)
    accepted, rejected = (urls.Markov([urls.plain(u[7:]) for u in part]) for part in (good, bad))
    new = ["http://unseen.example.com", "http://casino-new.example.org", good[0], good[0]]
    got = [r["ratio"] for r in urls.judge(pages(spark, good + bad + new), model, rules=(("zz/", "allow"),)).orderBy("page_id").collect()]
    want = [rejected.score(t) - accepted.score(t) for t in (urls.plain(u[7:]) for u in good + bad + new)]
    assert len(got) == len(want) and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


def test_path_and_query_count(spark):
    """Addresses of one neutral host are told apart by what follows it; one without a host is judged as well."""
    good = [f"http://{h}.example.org/en/articles/{k * 37 % 101}-weather?page={k}" for h in ("river", "stone", "cloud", "field") for k in range(9)]
    bad = [f"http://casino{k % 3}.bet.example.org/play/slots-bonus?win=cash{k}" for k in range(36)]
    model = urls.fit(pages(spark, good + bad))
    new = {"http://meadow.example.org/play/slots-bonus?win=cash7": "block", "http://meadow.example.org/en/articles/7-weather?page=2": "allow", "http:///play/slots-bonus?win=cash7": "block", "http://meadow.example.org/?play/slots-bonus?win=cash#weather": "block"}
    got = urls.judge(pages(spark, list(new)), model, rules=(("zz/", "allow"),)).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == list(new.values())


def test_address(spark):
    given = {"HTTP://A.org/B?c=1#d": "a.org/B?c=1", "http://a?x/y": "a?x/y", "no scheme#x": "", None: "", "a://b\n/c\nd": "b\n/c\nd", "http://#x": ""}
    got = pages(spark, list(given)).select("page_id", urls.address(F.col("url")).alias("a")).orderBy("page_id").collect()
    assert [r["a"] for r in got] == list(given.values())


def test_few_hosts_are_held_out_one_by_one(spark):
    good, bad = ["thing.org", "weather.org", "tion.org", "other.org", "thinner.org"], ["casino-win.org", "bet-lucky.org", "cheap-pills.org"]
    model = urls.fit(pages(spark, [f"http://{h}" for h in good + bad]))
    accepted, rejected = urls.Markov(good), urls.Markov(bad)
    held = lambda kind, h: urls.Markov([x for x in kind if x != h])
    want = urls.cut([rejected.score(h) - held(good, h).score(h) for h in good], [held(bad, h).score(h) - accepted.score(h) for h in bad])
    assert math.isclose(model.threshold, want, abs_tol=1e-9)
    assert math.isclose(urls.train(good, bad).threshold, want, abs_tol=1e-9)
    assert not math.isclose(want, urls.cut([rejected.score(h) - accepted.score(h) for h in good], [rejected.score(h) - accepted.score(h) for h in bad]), abs_tol=0.01)


def test_threshold_counts_every_address(spark):
    """More than 4000 addresses of a kind, all of which the threshold is fitted to: the plain models say where it lies."""
    rng = random.Random(4)
    some = lambda letters: "".join(rng.choices(letters, k=6))
    good = sorted({f"{h}.org/{some('abcdefgh')}" for h in ("thing", "weather", "tion") for _ in range(2_000)})
    bad = sorted({f"{h}.org/{some('cdefghij')}" for h in ("thing-win", "weather-bet", "tion-ads") for _ in range(700)})
    model = urls.fit(pages(spark, [f"http://{u}" for u in good + bad]))

    def held(kind, other, sign):
        kind, out = [urls.plain(u) for u in kind], []
        for h in {u.split("/")[0] for u in kind}:
            rest = urls.Markov([u for u in kind if not u.startswith(h)])
            out += [sign * (rest.score(u) - other.score(u)) for u in kind if u.startswith(h)]
        return out

    accepted, rejected = (urls.Markov([urls.plain(u) for u in kind]) for kind in (good, bad))
    assert math.isclose(model.threshold, urls.cut(held(good, rejected, -1), held(bad, accepted, 1)), abs_tol=1e-9)


def test_cut_of_a_table(spark):
    """Over several ranges of ratios, with ties and flat stretches, the cut is the plain one."""
    rng = random.Random(7)
    cases = [([0.5], [0.5]), ([1.0], [2.0]), ([2.0], [1.0]), ([1.0, 1.0, 3.0], [2.0]), ([0.0, 4.0], [1.0, 2.0, 3.0, 5.0])]
    cases += [([rng.choice(grid) for _ in range(n)], [rng.choice(grid) + shift for _ in range(m)]) for grid, n, m, shift in (([k / 8 for k in range(40)], 60, 25, 1.0), ([k / 8 for k in range(400)], 50, 50, 0.0), ([0.0, 1.0], 9, 9, 0.0))]
    cases.append(([k / 4 for k in range(20)], [k / 4 + 1 / 8 for k in range(20)]))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    for apart in ("false", "true"):
        spark.conf.set(setting, apart)
        try:
            for good, bad in cases:
                rows = [(r, good.count(r), bad.count(r)) for r in {*good, *bad}]
                got = urls.cut_table(spark.createDataFrame(rows, "ratio double, good long, bad long"))
                assert got == urls.cut(good, bad), (good, bad)
        finally:
            spark.conf.unset(setting)
