"""DuckDB SQL of the prefix trie and of the Merkle manifest."""

from __future__ import annotations

LEVELS = 5
"""Levels of 16 that the manifest's SQL unrolls: 16**5 rows a source."""


def crc32(digits: str) -> str:
    """The CRC-32 of a text of ASCII characters, bit by bit."""
    step = "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_transform(range(length({digits})), lambda i: ord({digits}[i + 1]))"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(8), {step}, xor(c, b)), 4294967295), 4294967295)"


PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS said
  FROM turns GROUP BY conv_id
), lent AS (
  SELECT conv_id, said, {crc32("digits")} % 6 AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.said, 1, a.h), []), list_slice(a.said, a.h + 1, len(a.said))) AS said
  FROM lent a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), passed AS (
  SELECT conv_id, list_slice(said, 1, depth) AS said, depth, depth = len(said) AS ends FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT said, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM passed GROUP BY said, depth
), children AS (
  SELECT list_slice(said, 1, depth - 1) AS said, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), facts AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(nodes.said[depth].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children ON children.said = nodes.said
), sums AS (
  SELECT top AS said, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT list_slice(said, 1, unnest(range(depth + 1))) AS top, saved, n_children FROM facts) GROUP BY top
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s ON s.said = f.said LEFT JOIN nodes p ON f.depth > 0 AND p.said = list_slice(f.said, 1, f.depth - 1)
"""


def _framed(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, leaves: str) -> list[str]:
    """The levels {name}0.. of a tree for each g of leaves(g, pos, node, total), and their runs {name}r0.."""
    hashed = "CASE WHEN max(total) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END"
    out = [f"{name}0 AS ({leaves})"]
    for k in range(LEVELS):
        out.append(f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, {hashed} AS node, (max(total) + 15) // 16 AS total FROM {name}{k} GROUP BY g, pos // 16)")
        out.append(f"{name}r{k} AS (SELECT g, pos // 16 AS run, list(node ORDER BY pos) AS nodes, max(total) AS total FROM {name}{k} GROUP BY g, pos // 16)")
    return out


def _climb(before: str) -> tuple[list[str], str]:
    """The way of each row up both trees: its siblings so far, and what its leaf has become."""
    out = []
    for name, place, group in (("a", "pos", "p.g"), ("b", "place", "''")):
        for k in range(LEVELS):
            at = f"(p.{place} // {16**k})"
            left, right = f"array_to_string(list_slice(r.nodes, 1, {at} % 16), '')", f"array_to_string(list_slice(r.nodes, {at} % 16 + 2, 16), '')"
            proof, node = f"CASE WHEN r.total = 1 THEN '' ELSE {left} || {right} END", f"CASE WHEN r.total = 1 THEN p.node ELSE sha256({left} || p.node || {right}) END"
            out.append(f"{name}p{k} AS (SELECT p.doc_id, p.g, p.leaf, p.pos, p.place, p.subroot, p.proof || {proof} AS proof, {node} AS node FROM {before} p JOIN {name}r{k} r ON r.g = {group} AND r.run = {at} // 16)")
            before = f"{name}p{k}"
    return out, before


def merkle_manifest() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    climb, end = _climb("(SELECT numbered.*, folded AS node, '' AS proof, tops.pos AS place, tops.node AS subroot FROM numbered JOIN tops ON tops.name = numbered.g)")
    parts = [
        f"docs AS (SELECT *, coalesce('s' || source, 'n') AS g, {_leaf('text')} AS leaf, CAST(doc_id AS VARCHAR) AS digits, {lowered} AS low FROM documents)",
        f"bent AS (SELECT *, CASE WHEN {crc32('digits')} % 5 = 0 THEN {_leaf('low')} ELSE leaf END AS folded FROM docs)",
        "numbered AS (SELECT doc_id, g, leaf, folded, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM bent)",
        *_tree("a", "SELECT g, pos, leaf AS node, total FROM numbered"),
        f"tops AS (SELECT g AS name, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM a{LEVELS})",
        *_tree("b", "SELECT '' AS g, pos, node, total FROM tops"),
        *climb,
    ]
    last = f"SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, {end}.node AS folded_root, {end}.node = root.node AS verified FROM {end} CROSS JOIN b{LEVELS} root"
    return "WITH " + ",\n".join(parts) + "\n" + last
