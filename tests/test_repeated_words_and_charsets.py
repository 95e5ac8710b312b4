"""Pages that a few words fill, whose letters alone would speak for another charset, against the SQL."""

import pytest
from evidencelake.functions import charsets
from test_references_and_charsets import differences

#: In check_l's own pages such words made Greek and Cyrillic of Latin; the others do so to Chinese and Russian.
WORDS = ("theatiou", "üü üü, cherge väüe", "èouré anouê, ç", "éouéou", "èéé.", "éê", "pfpf", "of", "noñboos", "erüerü")


def unlike_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found, n = differences(spark, str(tmp_path), "e11_other_charsets")
    assert n == len(rows)
    return found


def test_a_repeated_word_speaks_once(spark, tmp_path):
    rows = [(4 * i + k, f"<body><article><p>{' '.join([w] * 200)}</p></article></body>") for i, w in enumerate(WORDS) for k in range(4)]
    assert unlike_sql(spark, tmp_path, rows) == []


def test_pages_without_html_or_number(spark, tmp_path):
    assert unlike_sql(spark, tmp_path, [(None, "<article>of</article>"), (-1, "<article>of</article>"), *((k, None) for k in (-4, 0, 1, 2, 3))]) == []


@pytest.mark.parametrize(("text", "charset"), [("une création, l'année, Größe und Füße, süß, à, où, ç", "cp1252"), ("привет и программа <b>IT-отдел</b> в москве", "cp1251"), ("привет и программа <b>IT-отдел</b> в москве", "koi8_r"), ("οι λόγος της και του αυτός", "cp1253"), ("今天在café和über的人", "gb18030")])
def test_words_of_one_script(text, charset):
    page = f"<html><body><p>{text}</p></body></html>"
    assert charsets.guess(page.encode(charset)) == charset == charsets.guess((page * 300).encode(charset))
