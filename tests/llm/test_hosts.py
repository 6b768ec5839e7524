"""Suffix rules, and posteriors against a direct computation."""

import math
import random

from pyspark.sql import functions as F

from tidewright.llm import hosts

RULES = ["com", "co.uk", "*.ck", "!www.ck", "a.b.c.example", "github.io"]


def expected(host, rules):
    """Labels of the suffix, as public suffix lists are read."""
    labels = host.split(".")
    best = 1
    for k in range(1, len(labels) + 1):
        tail = ".".join(labels[-k:])
        if "!" + tail in rules:
            return k - 1
        if tail in rules or k > 1 and "*." + ".".join(labels[-k + 1 :]) in rules:
            best = k
    return best


def test_suffix_rules(spark, tmp_path):
    names = ["a.com", "com", "x.y.co.uk", "co.uk", "uk", "a.ck", "b.a.ck", "www.ck", "x.www.ck", "ck", "z.a.b.c.example", "b.c.example", "u.github.io", "x.u.github.io", "localhost", "x.de"]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    (tmp_path / "list.dat").write_text("// a comment\n\n" + "\n".join(RULES) + " and more\n")
    rules = hosts.read_suffixes(spark, str(tmp_path / "list.dat"))
    assert sorted(rules) == sorted(RULES)
    for r in df.select("h", hosts.suffix_of(F.col("h"), rules).alias("s"), hosts.domain_of(F.col("h"), rules).alias("d")).collect():
        labels, k = r["h"].split("."), expected(r["h"], RULES)
        assert (r["s"], r["d"]) == (".".join(labels[-k:]), ".".join(labels[-k - 1 :])), r["h"]


def test_neighbours_under_a_suffix_dont_share_a_fate(spark):
    bad = [(f"http://bad.{s}/{i}", 0) for s in ("edu.au", "github.io") for i in range(80)]
    good = [(f"http://g{i}.example/x", 1) for i in range(40) for _ in range(10)]
    outcomes = spark.createDataFrame(bad + good, "url string, good int")
    pages = spark.createDataFrame([(1, "http://good.edu.au/"), (2, "http://other.github.io/"), (3, "http://bad.edu.au/"), (4, "http://www.bad.github.io/")], "page_id long, url string")
    found = {r["page_id"]: r for r in hosts.filter_urls(pages, outcomes, rules=[]).collect()}
    assert [found[i]["verdict"] for i in (3, 4)] == ["block", "block"]
    assert found[1]["posterior_mean"] > found[3]["posterior_mean"] and found[2]["posterior_mean"] > found[4]["posterior_mean"]


def test_posteriors_of_mixed_hosts(spark):
    """Means, bounds and strengths are those of the formulas, over hosts of few and many pages, with repeated outcomes."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        share, suffix = rng.random(), rng.choice(["com", "org", "co.uk"])
        rows += [(f"http://{rng.choice(['a', 'b'])}.d{i}.{suffix}/p", int(rng.random() < share)) for _ in range(rng.choice([1, 2, 5, 40]))]
    rows += rows[:20]
    own, domain, suffix, (share, _) = hosts.reputation(spark.createDataFrame(rows, "url string, good int"))

    def counted(key):
        out = {}
        for url, good in rows:
            k, n = out.get(key(url.split("/")[2]), (0, 0))
            out[key(url.split("/")[2])] = (k + good, n + 1)
        return out

    size = lambda h: 2 if h.endswith("co.uk") else 1
    name = {"suffix": lambda h: ".".join(h.split(".")[-size(h) :]), "domain": lambda h: ".".join(h.split(".")[-size(h) - 1 :]), "host": lambda h: h}
    groups = {level: counted(f) for level, f in name.items()}

    def strength(of):
        total = sum(n for _, n in of.values())
        p = sum(k for k, _ in of.values()) / total
        spread = sum(n * (k / n - p) ** 2 for k, n in of.values())
        rho = (spread / (p * (1 - p)) - (len(of) - 1)) / (total - sum(n * n for _, n in of.values()) / total - (len(of) - 1))
        return min(1000.0, max(0.5, 1 / rho - 1 if rho > 0 else 1000.0))

    assert math.isclose(share, sum(g for _, g in rows) / len(rows))
    means = {"": share}
    for level, above, table in (("suffix", None, suffix), ("domain", "suffix", domain), ("host", "domain", own)):
        pull, got = strength(groups[level]), {r[level]: r for r in table.collect()}
        assert set(got) == set(groups[level])
        prefix = "" if level == "host" else f"{level}_"
        for key, (k, n) in groups[level].items():
            mean = (k + pull * means[name[above](key) if above else ""]) / (n + pull)
            means[key] = mean
            assert math.isclose(got[key][f"{prefix}mean"], mean, rel_tol=1e-9)
            assert math.isclose(got[key][f"{prefix}upper"], mean + 1.645 * math.sqrt(mean * (1 - mean) / (n + pull + 1)), rel_tol=1e-9)
