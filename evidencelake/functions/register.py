"""SQL surface: scalar rules as SQL functions, HTML nodes and identifiers as table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType

from evidencelake.functions.text import IDENTIFIERS
from evidencelake.operators.html import parse_nodes

#: SQL functions by name: parameters and body; they are inlined, so that nothing leaves the JVM.
SQL_FUNCTIONS = {
    "fold": ("c STRING", "STRING", "replace(lower(c), 'ß', 'ss')"),
    "resource_key": ("kind STRING, k STRING", "STRING", "sha2(concat_ws(':', kind, k), 256)"),
    "blob_id": ("body BINARY", "STRING", "concat('sha256:', sha2(body, 256))"),
    "backoff_seconds": ("attempt INT", "BIGINT", "cast(least(pow(2, attempt - 1), 4) as bigint)"),
    "normalize_newlines": ("c STRING", "STRING", r"replace(replace(c, '\r\n', '\n'), '\r', '\n')"),
    "clean_tag": ("c STRING", "STRING", "nullif(substring(trim(regexp_replace(trim(c), '^#+', '')), 1, 64), '')"),
}


@pandas_udf(StringType())
def decoded_text(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


class HtmlNodes:
    """SELECT * FROM html_nodes(html): node_id, parent_id, end_id, tag, text."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n in parse_nodes(html):
            yield n["node_id"], n["parent_id"], n["end_id"], n["tag"], n["text"]


class Identifiers:
    """SELECT * FROM identifiers_of(text): type, value, each once."""

    def eval(self, text: str) -> Iterator[tuple]:
        seen = set()
        for kind, pattern in IDENTIFIERS.items():
            for m in re.finditer(pattern, text or ""):
                value = m.group(1).rstrip(".,;)>]") if kind == "DOI" else m.group(1)
                key = (kind, value.lower())
                if key not in seen:
                    seen.add(key)
                    yield kind, value.upper() if kind in ("PMCID", "NCT") else value


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("decoded_text", decoded_text)
    spark.udtf.register("html_nodes", udtf(HtmlNodes, returnType="node_id int, parent_id int, end_id int, tag string, text string"))
    spark.udtf.register("identifiers_of", udtf(Identifiers, returnType="type string, value string"))
