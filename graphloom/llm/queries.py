"""Queries of the llm operators over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.generated import classify_files
from graphloom.llm.leakage import leaked_passages
from graphloom.llm.mixing import mix_sources
from graphloom.llm.secrets import find_secrets, redact_secrets, secret_rows
from graphloom.llm.shared_spans import later_spans, shared_parts, shared_spans
from graphloom.llm.syntax import fault_rates, parse_faults
from graphloom.session import table

#: Vocabulary of the token counts; the files are described in the README of that folder.
VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files that were not written by hand in their project."""
    return p1_files(spark, d).where("not hand_written").select("doc_id").distinct()


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Every source file with what speaks against handwork, and its family."""
    return classify_files(table(spark, d, "documents"), table(spark, d, "file_filter_options"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Properties and documents that hold a usable secret."""
    return find_secrets(secret_rows(table(spark, d, "parsed_properties"), table(spark, d, "documents"))).select("src_table", "row_id").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Their texts with the secrets redacted."""
    return redact_secrets(secret_rows(table(spark, d, "parsed_properties"), table(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files that are not valid in the language of their file name."""
    return parse_faults(table(spark, d, "documents")).where("fault is not null").select("doc_id").distinct()


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every source file with its fault, if any."""
    return parse_faults(table(spark, d, "documents"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files by project and language, and how many of them were reported."""
    return fault_rates(table(spark, d, "documents"), table(spark, d, "parse_errors"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 15 consecutive words of an evaluation item."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, with their repetitions."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[1]


def p9_exact_report(spark: SparkSession, d: str) -> DataFrame:
    """The same for the largest mixture in which every source there is meets its share."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY, total="exact")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with an identical span of 400 or more characters."""
    return shared_spans(table(spark, d, "documents")).document_pairs()


def p10_shared_parts(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document is found elsewhere."""
    return shared_parts(table(spark, d, "documents"))


def p10_later_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans to remove so that the earliest occurrence stays."""
    return later_spans(table(spark, d, "documents"))


QUERIES = {q.__name__: q for q in (p1_found, p1_files, p5_found, p5_redacted, p6_found, p6_faults, p6_rates, p8_found, p9_selection, p9_report, p9_exact_report, p10_found, p10_shared_parts, p10_later_spans)}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _runs(key: str, source: str) -> str:
    words = f"SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 14], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 13)) AS i FROM ({words}))"


#: Windows of 400 characters that several documents hold, and the spans they cover.
_WINDOWS = """h AS (SELECT doc_id, i, md5(substr(text, i, 400)) AS part FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
 o AS (SELECT part, min(doc_id) AS first FROM h GROUP BY part HAVING min(doc_id) < max(doc_id)),"""


def _spans(where: str) -> str:
    return f"""{_WINDOWS} w AS (SELECT doc_id, i - 1 AS s, i + 399 AS e FROM h JOIN o USING (part) {where}),
 m AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM w),
 g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM m),
 r AS (SELECT doc_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY doc_id, g)"""


ORACLE_SQL: dict[str, str] = {
    "p10_shared_parts": f"""WITH {_spans('')}, t AS (SELECT doc_id, sum("end" - start)::BIGINT AS n FROM r GROUP BY doc_id)
 SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0 END AS share FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "p10_later_spans": f"WITH {_spans('WHERE doc_id > first')} SELECT * FROM r",
    "p8_found": f"SELECT DISTINCT d.doc_id, e.item_id FROM ({_runs('doc_id', 'documents')}) d JOIN ({_runs('item_id', 'eval_items')}) e ON d.run = e.run",
    "p10_found": """WITH h AS (SELECT DISTINCT doc_id, md5(substr(text, i, 400)) AS part FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400))
 SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.part = b.part AND a.doc_id < b.doc_id""",
}
