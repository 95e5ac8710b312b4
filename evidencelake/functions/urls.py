"""URL identity: normalisation, rejection, classification, domains, addresses. Native columns throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions by kind.
VIDEO = (".mp4", ".mov", ".mkv", ".webm", ".m4v")
AUDIO = (".mp3", ".m4a", ".aac", ".wav", ".flac", ".ogg", ".opus")
WORD = (".doc", ".docx", ".odt")
SPECIAL_HOST = "mp.weixin.qq.com"
#: IPv4 ranges that are not global; first and last address.
RESERVED = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
BENCHMARK_RANGE = ("198.18.0.0", "198.19.255.255")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(strip(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def hostname(c: Column) -> Column:
    return F.lower(F.regexp_extract(authority(c), r"^(?:.*@)?\[?([^:\]]*)", 1))


def path_of(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_reject_reason(c: Column) -> Column:
    """null for an acceptable URL; credentials are refused before normalisation would drop them."""
    port = F.regexp_extract(authority(c), r":([^:\]@]*)$", 1)
    bad_port = ~port.rlike(r"^\d*$") | (F.length(port) > 5) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535)
    return (
        F.when(c.isNull() | (strip(c) == ""), "blank")
        .when(~scheme(c).isin("http", "https"), "unsupported_scheme")
        .when(hostname(c) == "", "no_host")
        .when(authority(c).contains("@"), "embedded_credentials")
        .when(bad_port, "bad_port")
    )


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment or user, path at least /; null where the URL is not http(s)."""
    port = F.regexp_extract(authority(c), r":(\d+)$", 1)
    default = ((scheme(c) == "https") & (port == "443")) | ((scheme(c) == "http") & (port == "80")) | (port == "") | (port == "0")
    query = F.regexp_extract(strip(c), r"^[^?#]*(\?[^#]+)", 1)
    path = F.when(path_of(c) == "", "/").otherwise(path_of(c))
    whole = F.concat(scheme(c), F.lit("://"), hostname(c), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, query)
    return F.when(scheme(c).isin("http", "https") & (hostname(c) != ""), whole)


def _ends(c: Column, endings: tuple[str, ...]) -> Column:
    return c.rlike("(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$")


def classify_url(c: Column) -> Column:
    p = F.lower(path_of(c))
    return (
        F.when(hostname(c) == SPECIAL_HOST, "wechat_article").when(p.endswith(".pdf"), "pdf").when(_ends(p, VIDEO), "video").when(_ends(p, AUDIO), "podcast").when(_ends(p, WORD), "word").otherwise("web_page")
    )


def classify_upload(name: Column, mime: Column) -> Column:
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf")
        .when(_ends(n, WORD) | m.contains("wordprocessingml") | (m == "application/msword"), "word")
        .when(m.startswith("video/") | _ends(n, VIDEO), "video")
        .when(m.startswith("audio/") | _ends(n, AUDIO), "podcast")
        .when(m.startswith("text/") | _ends(n, (".txt", ".md")), "text")
        .otherwise("binary_file")
    )


def domain_candidates(c: Column) -> Column:
    """The host and its parents of two labels or more, longest first."""
    labels = F.split(hostname(c), r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, n)))).otherwise(F.array().cast("array<string>"))


def date_from_url(c: Column) -> Column:
    loose = r"/(20\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])"
    tight = r"/(20\d{2})(0[1-9]|1[0-2])([0-3]\d)/"
    day = lambda p: F.concat(F.regexp_extract(c, p, 1), F.lit("-"), F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(c, p, 3), 2, "0"), F.lit(" 00:00:00"))
    return F.when(F.regexp_extract(c, loose, 1) != "", day(loose)).when(F.regexp_extract(c, tight, 1) != "", day(tight))


def ipv4_number(c: Column) -> Column:
    """The address as a number; null where it isn't a dotted quad."""
    parts = F.split(c, r"\.")
    n = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(c.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"), n)


def is_public_ipv4(c: Column, allow_benchmark: bool = False) -> Column:
    """False for reserved ranges and for what isn't an address. The fixed ranges are one expression, so nothing is joined."""
    n = ipv4_number(c)
    number = lambda a: sum(int(x) << s for x, s in zip(a.split("."), (24, 16, 8, 0), strict=True))
    reserved = F.lit(False)
    for low, high in RESERVED:
        if not (allow_benchmark and (low, high) == BENCHMARK_RANGE):
            reserved = reserved | n.between(number(low), number(high))
    return F.coalesce(~reserved, F.lit(False))


def allowed_hosts(urls: DataFrame, url: str, allow: DataFrame) -> DataFrame:
    """https rows whose host, or a parent of it, is in allow (domain)."""
    d = urls.where(scheme(F.col(url)) == "https").withColumn("_d", F.explode(domain_candidates(F.col(url))))
    hit = d.join(allow.select(F.col("domain").alias("_d")).distinct(), "_d", "left_semi")
    return hit.drop("_d").distinct()
