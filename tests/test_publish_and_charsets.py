"""Evidence that is seen whole or not at all; uploads over the reader's limit; events once for good; charsets without a library."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import charsets
from evidencelake.sources import readers, sinks
from evidencelake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
RUSSIAN = "Привет, мир! Это обычный русский текст, в котором есть слова и знаки."
CHINESE = "这是一个普通的中文网页，里面有很多常用的字，也有标点。"
JAPANESE = "これは普通の日本語の文章です。漢字とかなが混ざっています。"


@pytest.mark.parametrize(("text", "charset"), [(RUSSIAN, "cp1251"), (RUSSIAN, "koi8_r"), (CHINESE, "gb18030"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), ("Füße über Öl, ça déjà vu, año", "cp1252"), ("這是一個普通的中文網頁，裡面有很多常用的字。", "big5"), ("이것은 평범한 한국어 문장입니다.", "euc_kr"), ("καλημέρα κόσμε και πάλι", "cp1253"), ("plain text of Latin", "utf_16_le"), (CHINESE + " and text", "utf_16_be")])
def test_charsets(text, charset):
    page = "<html><body><p>" + text * 3 + "</p></body></html>"
    assert charsets.guess(page.encode(charset)) == charset
    assert charsets.guess((page * 200).encode(charset)) == charset


def test_charset_ends():
    assert charsets.guess(None) is None and charsets.guess(b"") is None
    assert charsets.guess("a一".encode("utf-16")) == "utf_16" and charsets.guess(b"\xff\x81\x00") is not None


def evidence(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), m) for i, h, m in rows], "evidence_id string, fetched_at timestamp, markdown string")


def seen(spark, root):
    return sorted((r["evidence_id"], r["markdown"]) for r in sinks.read_evidence(spark, root).collect())


def test_publish_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/ev"
    with pytest.raises(FileNotFoundError):
        sinks.read_evidence(spark, root)
    first = evidence(spark, [("a", 1, "1"), ("b", 2, "1"), ("c", 30, "1")])
    for _ in range(2):
        sinks.write_evidence(first, root, "first")
    before = seen(spark, root)
    assert before == [("a", "1"), ("b", "1"), ("c", "1")]
    again = evidence(spark, [("a", 1, "2"), ("d", 3, "2")])
    publish = sinks._publish
    for broken in ("before the move", "after it"):

        def fail(*args, broken=broken):
            if broken == "after it":
                with monkeypatch.context() as m:
                    m.setattr(sinks.json, "dumps", lambda *a: 1 / 0)
                    publish(*args)
            raise OSError(broken)

        with monkeypatch.context() as m:
            m.setattr(sinks, "_publish", fail)
            with pytest.raises((OSError, ZeroDivisionError)):
                sinks.write_evidence(again, root, "second", rebuild=True)
        assert seen(spark, root) == before
    held = sinks.read_evidence(spark, root)  # a reader from before
    for _ in range(2):
        sinks.write_evidence(again, root, "second", rebuild=True)
    assert seen(spark, root) == [("a", "2"), ("b", "1"), ("c", "1"), ("d", "2")]
    assert sorted(r["markdown"] for r in held.collect()) == ["1", "1", "1"]


def test_uploads_over_the_readers_limit(spark, tmp_path):
    for name, size in (("small.txt", 10), ("large.txt", 80), ("huge.txt", 500), ("none.txt", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "100")
    try:
        for most, large in ((50, "too_large"), (90, None), (1 << 30, None)):
            got = {r["filename"]: (r["reject"], r["size_bytes"], r["sha256"] is not None) for r in readers.read_uploads(spark, f"{tmp_path}/*", most).collect()}
            assert got == {"small.txt": (None, 10, True), "large.txt": (large, 80, large is None), "huge.txt": ("too_large", 500, False), "none.txt": ("empty", 0, False)}
    finally:
        spark.conf.unset(key)


def test_an_event_is_once_for_good(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKSDB)
    s = lambda seconds: T0 + dt.timedelta(seconds=seconds)
    batches = [[(f"e{i}", s(i % 3)) for i in range(40)] + [("e1", s(1)), (None, s(1))], [("x", s(5000)), ("e7", s(4999))], [("e3", s(9000)), ("y", s(9001)), ("x", s(9002))], [("z", s(20000)), ("e39", s(20000)), ("y", s(20001))]]
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, "id string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        e = spark.readStream.schema("id string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = jobs.dedupe_with_ledger(e, "id", "at", "10 seconds", f"{tmp_path}/out", f"{tmp_path}/ck", 4)
        assert sorted(r["id"] for r in got.collect()) == sorted([f"e{i}" for i in range(40)] + ["x", "y", "z"])
        assert all(len(n) <= 2 for n in jobs._batches_of(spark, f"{tmp_path}/out/filters").values())
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
