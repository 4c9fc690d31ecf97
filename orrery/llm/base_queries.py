"""The parts of operators' results that SQL can express, each taken from the operator itself, and their SQL.

The rest of these operators (added spans, scores, verdicts of models) has no
SQL form and is held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import LOWER, UPPER, table
from orrery.llm.pii import op3_pii
from orrery.llm.quality_rules import op7_quality_rules
from orrery.llm.secret_scan import op2_secret_scan
from orrery.llm.url_filter import RULES, op5_url_filter

WORD = r"[^\x20\x09-\x0D]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
# The base patterns of the contracts, and what a match must hold; m is the match, g its second group.
SECRETS = {
    "assign": (rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", 2),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 18", 0),
    "hex": (r"[0-9a-f]+", "length(m) >= 16", 0),
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT)
  ELSE list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1) END)) % 10 = 0"""
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE", 0),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(x, 3) AS INT), 0) <= 255))",
        0,
    ),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0),
}


def spans_sql(kinds: dict[str, tuple[str, str, int]]) -> str:
    """doc_id, a count for each kind, and the hash of their spans: places come from the pieces between matches."""
    parts = []
    for rank, (kind, (pattern, keep, group)) in enumerate(kinds.items()):
        parts.append(f"""{kind}_ AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, g, sum(length(gap) + coalesce(lag_length, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS start FROM (
  SELECT doc_id, i, gaps[i] AS gap, hits[i] AS m, groups[i] AS g, length(hits[i - 1]) AS lag_length FROM (
  SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS groups FROM d),
  LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i))) WHERE {keep})""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    zeros = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in kinds)
    every = " UNION ALL ".join(f"SELECT * FROM {k}_" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
s AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans FROM ({every}) GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id)"""


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i:i + 2] AS k FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM
  (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS times FROM t) WHERE times > 1) GROUP BY doc_id),
q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q"""


def _url_sql() -> str:
    """Host, path and the longest rule that fits."""
    tests = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    after = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
    return f"""SELECT page_id, host, path, CASE{tests} END AS rule FROM (SELECT page_id,
coalesce(translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path
FROM (SELECT page_id, {after} AS after FROM pages))"""


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in SECRETS), "base_sha256")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in PERSONAL), "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op7_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (secret_scan_base, personal_data_base, quality_base, url_rules)}


def oracle_sql() -> dict[str, str]:
    return {
        "secret_scan_base": spans_sql(SECRETS),
        "personal_data_base": spans_sql(PERSONAL),
        "quality_base": QUALITY_SQL,
        "url_rules": _url_sql(),
    }
