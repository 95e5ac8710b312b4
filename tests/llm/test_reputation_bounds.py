"""The beta posterior of host reputations, and hosts that carry ports, user names or suffixes of two labels."""

import numpy as np
from pyspark.sql import functions as F

from evidencelake.llm import url_filter


def mass_below(a, b, limit):
    """By the midpoint rule over log-odds, where the density has no poles."""
    z = np.linspace(-600, 600, 3_000_001)
    z = (z[1:] + z[:-1]) / 2
    d = -a * np.logaddexp(0, -z) - b * np.logaddexp(0, z)
    w = np.exp(d - d.max())
    return w[z < np.log(limit / (1 - limit))].sum() / w.sum()


def test_beta_mass_against_integration(spark):
    cases = [(a, b, x) for x in (0.5, 0.2, 0.9) for a, b in ((0.5, 0.5), (0.05, 3.0), (3.0, 0.2), (1, 1), (7.5, 2.25), (40, 60), (800, 700), (5200, 4800), (9000, 1000))]
    for x in (0.5, 0.2, 0.9):
        d = spark.createDataFrame([(float(a), float(b)) for a, b, y in cases if y == x], "a double, b double")
        for r in d.withColumn("m", url_filter.beta_below(F.col("a"), F.col("b"), x)).collect():
            assert abs(r["m"] - mass_below(r["a"], r["b"], x)) < 3e-4, (r, x)


def test_ports_user_names_and_suffixes(spark):
    rows = [("u:p@H.Bad.co.uk:8080", "h.bad.co.uk"), ("h.com.", "h.com"), ("h.com:", "h.com"), ("h", "h"), ("", ""), ("[::1]:80", "[::1]")]
    d = spark.createDataFrame(rows, "host string, want string")
    assert all(r["got"].lower() == r["want"] for r in d.withColumn("got", url_filter.site_of(F.col("host"))).collect())
    outcomes = [("a.one.co.uk", 400, 400), ("b.one.co.uk", 300, 300), ("c.two.co.uk", 400, 0), ("d.two.co.uk", 300, 0), ("new.one.co.uk", 0, 0), ("new.two.co.uk", 0, 0)]
    got = {r["host"]: r["alpha"] / (r["alpha"] + r["beta"]) for r in url_filter.reputations(spark.createDataFrame(outcomes, "host string, n long, bad long")).collect()}
    assert got["new.one.co.uk"] > 0.9 and got["new.two.co.uk"] < 0.1  # each after its own registered domain


def test_a_page_on_another_port_has_its_hosts_reputation(spark):
    urls = [f"http://x.bad.net/es/{i}" for i in range(40)] + ["http://me@x.bad.net:81/de/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).where("page_id = 40").first()
    assert (got["host"], got["rule"], got["verdict"]) == ("me@x.bad.net:81", None, "block")
