"""Views of the test tables with headings and blank lines, built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions, as one small file does; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is a second-level heading; a blank line follows each line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(lines, "\n\n").alias("text"))


MD_DOCS = """md AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 7 = 0 THEN '## ' || x ELSE x END) AS ls FROM documents),
md_docs AS (SELECT doc_id, array_to_string(ls, chr(10) || chr(10)) AS text FROM md),
md_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM md_docs)"""

#: The white-space class and a sentence splitter for DuckDB's regular expressions.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CLOSERS = r"""["''）)\]】」』”’]"""


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


MARKED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([。！？…]+{CLOSERS}*|[.!?]+{CLOSERS}*)', '\1' || chr(1), 'g'),
 '([0-9][.!?]*\.)' || chr(1), '\1', 'g'), chr(1) || '((?:\n[ \t]*\n)*\n?)', '\1' || chr(1), 'g'), '(\n(?:{WS}*\n)+)', '\1' || chr(1), 'g')"""
SENTENCES = f"""sl AS (SELECT doc_id, list_filter(list_transform(string_split({MARKED}, chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS ss FROM documents),
sentences AS (SELECT doc_id, unnest(range(0, len(ss))) AS idx, unnest(ss) AS sentence FROM sl)"""
KEYED = f"""{SENTENCES},
normed AS (SELECT doc_id, idx, sentence, regexp_replace({sql_trim('sentence')}, '{WS}', '', 'g') AS norm FROM sentences WHERE length(sentence) >= 5),
keyed AS (SELECT doc_id, idx, sentence, length(norm) AS len_norm, regexp_replace(norm, '…+|\\.{{2,}}', '', 'g') AS match_key FROM normed)"""
