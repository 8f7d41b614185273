"""DuckDB oracle SQL fragments that are long enough to be generated."""

from __future__ import annotations

_U64_TO_I64 = ("(({u})::HUGEINT - CASE WHEN ({u}) >= 9223372036854775808::UBIGINT "
               "THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT")


def simhash_ctes(prefix: str, source: str, ids: list[str], text: str) -> str:
    """CTEs ending in ``{prefix}_fp(ids..., fp)``: the SimHash of ``text``
    (an SQL expression over ``source``) computed in plain SQL.  Underscores
    are removed first (the test-query normaliser)."""
    idl = ", ".join(ids)
    sums = ",\n    ".join(f"sum(((h >> {j}) & 1)::BIGINT) AS b{j}" for j in range(64))
    bits = " | ".join(f"(CASE WHEN b{j} * 2 > n THEN (1::UBIGINT << {j}) ELSE 0::UBIGINT END)"
                      for j in range(64))
    return f"""{prefix}_src AS (
  SELECT {idl}, regexp_replace(lower(replace({text}, '_', '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s
  FROM {source}
),
{prefix}_pos AS (
  SELECT {idl}, s, greatest(length(s) - 3, 1) AS n,
         unnest(range(1, greatest(length(s) - 3, 1) + 1)) AS i
  FROM {prefix}_src
),
{prefix}_sh AS (
  SELECT {idl}, n, ('0x' || substr(md5(substr(s, i, 4)), 17, 16))::UBIGINT AS h
  FROM {prefix}_pos
),
{prefix}_bits AS (
  SELECT {idl}, any_value(n) AS n,
    {sums}
  FROM {prefix}_sh GROUP BY {idl}
),
{prefix}_u AS (
  SELECT {idl}, {bits} AS u FROM {prefix}_bits
),
{prefix}_fp AS (
  SELECT {idl}, {_U64_TO_I64.format(u="u")} AS fp FROM {prefix}_u
)"""
