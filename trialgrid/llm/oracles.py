"""DuckDB SQL with the results of the queries that SQL can express at whole-table cost. The others are tested by brute force."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (SELECT key, max(doc_id) AS last_id FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, o.key IS NOT NULL AND l.doc_id <> o.last_id AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}


#: CRC-32 of a decimal number's text, bit by bit: a byte is folded in, then eight shifts, each marked by -1.
_CRC = """(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295))"""


def _merkle(levels: int = 7, top_levels: int = 5) -> str:
    """The manifest with its levels written out: 16 ** 7 leaves a source and 16 ** 5 sources pos most."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""rows AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC.format(x='doc_id')} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS now FROM documents)""",
           "n0 AS (SELECT (source IS NULL)::INT AS z, coalesce(source, '') AS g, *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS d FROM rows)"]

    def climb(name: str, keys: str, count: int) -> None:
        for k in range(count):
            out.append(f"{name}r{k} AS (SELECT {keys}, pos // 16 AS pos, (max(n) + 15) // 16 AS n, list(d ORDER BY pos) AS kids, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE n > 1 GROUP BY {keys}, pos // 16)")
            out.append(f"{name}{k + 1} AS (SELECT * FROM {name}r{k})")

    climb("n", "z, g", levels)
    tops = " UNION ALL ".join(f"SELECT z, g, d FROM n{k} WHERE n = 1" for k in range(levels + 1))
    out.append(f"tops AS ({tops})")
    out.append("m0 AS (SELECT 1 AS o, z, g, d, row_number() OVER (ORDER BY z DESC, encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tops)")
    climb("m", "o", top_levels)
    out.append("tree AS (" + " UNION ALL ".join(f"SELECT d FROM m{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")

    def steps(name: str, base: str, keys: str, count: int) -> str:
        for k in range(count):
            own = f"(b.pos // {16 ** k} % 16)"
            join = " AND ".join(f"b.{c} = r.{c}" for c in keys.split(", "))
            out.append(f"""{name}{k} AS (SELECT b.* EXCLUDE (proof, fold), b.proof || coalesce(array_to_string(r.kids[:{own}], '') || array_to_string(r.kids[{own} + 2:], ''), '') AS proof,
  CASE WHEN r.kids IS NULL THEN b.fold ELSE sha256(array_to_string(r.kids[:{own}], '') || b.fold || array_to_string(r.kids[{own} + 2:], '')) END AS fold
  FROM {base} b LEFT JOIN {name[0]}r{k} r ON {join} AND b.pos // {16 ** (k + 1)} = r.pos)""")
            base = f"{name}{k}"
        return base

    out.append("b0 AS (SELECT z, g, pos, doc_id, leaf, '' AS proof, now AS fold FROM n0)")
    last = steps("nf", "b0", "z, g", levels)
    out.append(f"b1 AS (SELECT 1 AS o, m0.pos AS pos, m0.d AS subroot, p.doc_id, p.leaf, p.proof, p.fold FROM {last} p JOIN m0 ON p.z = m0.z AND p.g = m0.g)")
    last = steps("mf", "b1", "o", top_levels)
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, tree.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = tree.d AS verified FROM {last}, tree"


SQL["op13_merkle_manifest"] = _merkle()
