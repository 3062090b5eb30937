"""op13: the main text of all pages, by a labeller fitted on layouts with their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_labeller import extract, fit

NAME = "op13_html_extraction"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The text inside the article element, which these pages declare: what the labeller should find without being told.
SQL = r"""
WITH inner_html AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS body FROM pages
),
blocks AS (
    SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(h1|p)>'), lambda x: trim(regexp_replace(
        replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'),
        '\s+', ' ', 'g'))), lambda x: x <> '') AS found
    FROM inner_html
)
SELECT page_id, url, array_to_string(found, chr(10)) AS text, length(array_to_string(found, chr(10))) AS n_chars FROM blocks
"""
