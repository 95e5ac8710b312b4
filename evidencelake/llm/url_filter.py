"""URL filter: explicit rules, and an empirical-Bayes reputation for hosts that no rule names. DataFrame functions only.

Labelled outcomes are the pages that a rule decides (allow: good, block: bad). Counts per host (without user names and ports)
are shrunk towards their registered domain, those towards the public suffix, those towards the whole table: at each level the
children's counts are beta-binomial with the parent's posterior mean and a strength found by moments from the spread between
children, no surer than the parent itself. A page without a rule is blocked when the lower posterior bound of its host's bad
rate exceeds a limit: the beta posterior puts at least SURE of its mass above it. So a host with no evidence is allowed unless
its domain's evidence condemns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import hash_bucket, materialize

#: (host, path, verdict). A list of at most 1,000: it becomes one expression.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MAX_RULES = 1000
SALTS = 16
#: Posterior mass above the limit that blocks; and the evidence, in pages, beyond which a posterior gets no narrower.
SURE, MOST_EVIDENCE = 0.95, 10_000.0
#: Public suffixes of two labels under which names are registered. Others are the last label.
SUFFIXES = tuple("ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk sch.uk com.au edu.au gov.au net.au org.au co.nz govt.nz net.nz org.nz ac.jp co.jp go.jp ne.jp or.jp ac.kr co.kr go.kr or.kr com.cn edu.cn gov.cn net.cn org.cn com.hk com.tw co.in gov.in net.in org.in com.sg com.my co.id co.th com.vn com.br gov.br net.br org.br com.ar com.mx com.co com.pe com.tr co.za org.za co.il com.ua com.pl com.pt com.es co.at or.at".split())
FRACTION_TERMS = 400


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user name, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series at x + 8, less the logarithms of x to x + 7."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    factors = x
    for i in range(1, 8):
        factors = factors * (x + i)
    return series - F.log(factors)


def beta_below(alpha: Column, beta: Column, limit: float) -> Column:
    """Mass of Beta(alpha, beta) below limit: the incomplete beta function by its continued fraction, evaluated from its end."""
    flip = F.lit(limit) > (alpha + 1) / (alpha + beta + 2)
    a, b = F.when(flip, beta).otherwise(alpha), F.when(flip, alpha).otherwise(beta)
    x = F.when(flip, 1 - limit).otherwise(F.lit(limit))

    def term(r: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(i % 2 == 0, even).otherwise(odd) / r

    fraction = F.aggregate(F.sequence(F.lit(FRACTION_TERMS), F.lit(1)), F.lit(1.0), term)
    front = F.exp(a * F.log(x) + b * F.log(1 - x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)) / a
    tail = front / fraction
    return F.when(flip, 1 - tail).otherwise(tail)


def decide(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (length, rule, verdict) of the longest fitting rule, or null."""
    if not 0 < len(rules) <= MAX_RULES:
        raise ValueError("1 to 1,000 rules")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.greatest(*fits, F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))


def _level(children: DataFrame, parent: str, prior: DataFrame) -> DataFrame:
    """Posterior (alpha, beta) of each row of children from its own (n, bad) and its parent's mean, with one strength per level."""
    total = F.col("alpha") + F.col("beta")
    base = materialize(children.join(prior.select(parent, (F.col("alpha") / total).alias("mean"), total.alias("surety")), parent), "level")
    n, x, m = F.col("n"), F.col("bad"), F.col("mean")
    spread = base.where("n > 0").agg(F.sum((x - n * m) ** 2 / (n * m * (1 - m))).alias("chi"), F.count("*").alias("k"), F.sum(n - 1).alias("extra")).first()
    # var(x) = n m (1 - m) (1 + (n - 1) rho); strength = 1 / rho - 1
    rho = min(0.5, max(0.001, (spread["chi"] - spread["k"]) / spread["extra"])) if spread["extra"] else 0.5
    strength = F.least(F.lit(1 / rho - 1), "surety")  # a child's prior is no surer than its parent
    return base.withColumn("alpha", strength * m + x).withColumn("beta", strength * (1 - m) + n - x).drop("surety", "mean")


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, alpha, beta) from (host, n, bad): one row per host. suffixes: public suffixes of two labels."""
    labels = F.split("host", r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, -n, n))
    pair = (F.size(labels) > 2) & last(2).isin(*suffixes)
    h = outcomes.withColumn("suffix", F.when(pair, last(2)).otherwise(F.element_at(labels, -1)))
    h = h.withColumn("domain", F.when(pair, last(3)).when(F.size(labels) > 1, last(2)).otherwise(F.col("host")))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    d = h.groupBy("domain", "suffix").agg(*sums)
    s = d.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0))
    root = s.groupBy("root").agg((F.sum("bad") + 0.5).alias("alpha"), (F.sum("n") - F.sum("bad") + 0.5).alias("beta"))
    return _level(h, "domain", _level(d, "suffix", _level(s, "root", root))).select("host", "alpha", "beta")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, limit: float = 0.5, sure: float = SURE, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_chance for every row of pages (page_id, url).

    bad_chance: the posterior chance that the host's bad rate exceeds the limit. Null urls and urls without :// have an empty
    host and path and are judged as one unknown host. Repeated rows come out as often as they came in. An empty table gives
    an empty result.
    """
    p = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    p = p.withColumn("hit", decide(F.col("host"), F.col("path"), rules))
    p = materialize(p.select("page_id", "host", "path", site_of(F.col("host")).alias("site"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled")), "judged")
    outcomes = materialize(p.groupBy(F.col("site").alias("host")).agg(F.count("rule").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad")), "outcomes")
    least = F.least(F.lit(1.0), MOST_EVIDENCE / (F.col("alpha") + F.col("beta")))
    known = reputations(outcomes, suffixes).select(F.col("host").alias("site"), (1 - beta_below(F.col("alpha") * least, F.col("beta") * least, limit)).alias("bad_chance"))
    known = materialize(known, "reputations")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = p.withColumn("salt", hash_bucket(SALTS, F.col("page_id"), F.col("path"))).join(salted, ["site", "salt"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad_chance") >= sure, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_chance")
