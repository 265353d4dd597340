"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations

#: Levels that the manifest's statement can climb inside a source and over sources; 16 to their power is the most nodes.
LEAF_LEVELS, SOURCE_LEVELS = 5, 3

_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _framed(text: str) -> str:
    cells = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in _COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cells) + ")"


def _levels(name: str, first: str, levels: int) -> list[str]:
    """Node tables ``<name>0`` (``grp, pos, h``) to ``<name><levels>``, with the siblings of every node in its run."""
    out, source = [], first
    for i in range(levels + 1):
        out.append(
            f"{name}{i} AS (SELECT *, count(*) OVER (PARTITION BY grp) > 1 AS many,"
            " coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            " coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
            f" FROM ({source}) WINDOW run AS (PARTITION BY grp, pos // 16 ORDER BY pos))"
        )
        source = (
            "SELECT grp, pos // 16 AS pos, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h"
            f" FROM {name}{i} GROUP BY 1, 2"
        )
    return out


def merkle_sql() -> str:
    """Leaves, levels of 16 by integer division, siblings by windows; crc32 bit by bit over a table of 256 codes."""
    step = "SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({})"
    codes = "SELECT n, n AS c FROM (SELECT unnest(range(256)) AS n)"
    for _ in range(8):
        codes = step.format(codes)
    start = "[CAST(4294967295 AS BIGINT)]"
    crc = (
        f"xor(list_reduce(list_concat({start}, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),"
        " lambda c, b: xor(c >> 8, codes.all_codes[1 + (xor(c, b) & 255)])), 4294967295)"
    )
    leaves = f"""leaves AS (SELECT doc_id, source, concat(CASE WHEN source IS NULL THEN '-' ELSE '=' END, coalesce(source, '')) AS grp, h,
 CASE WHEN hit THEN e ELSE h END AS e, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos
 FROM (SELECT doc_id, source, {_framed("text")} AS h, {_framed(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS e,
  coalesce({crc} % 5 = 0, false) AS hit FROM documents, codes))"""
    parts = [f"codes AS (SELECT list(CAST(c AS BIGINT) ORDER BY n) AS all_codes FROM ({codes}))", leaves]
    parts += _levels("n", "SELECT grp, pos, h FROM leaves", LEAF_LEVELS)
    tops = f"SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, h, grp AS name FROM n{LEAF_LEVELS}"
    parts.append(f"tops AS ({tops})")
    parts += _levels("s", "SELECT grp, pos, h FROM tops", SOURCE_LEVELS)
    joins, sides = ["leaves f JOIN tops t ON t.name = f.grp"], []
    for i in range(LEAF_LEVELS):
        joins.append(f"JOIN n{i} ON n{i}.grp = f.grp AND n{i}.pos = f.pos // {16**i}")
        sides.append(f"n{i}")
    for i in range(SOURCE_LEVELS):
        joins.append(f"JOIN s{i} ON s{i}.pos = t.pos // {16**i}")
        sides.append(f"s{i}")
    proof = " || ".join(f"{s}.l || {s}.r" for s in sides)
    cells = ", ".join(f"{s}.l AS l{i}, {s}.r AS r{i}, {s}.many AS m{i}" for i, s in enumerate(sides))
    folded = f"SELECT doc_id, f.h AS leaf, t.h AS subroot, f.e AS d, sha256({proof}) AS proof_sha256, {cells} FROM {' '.join(joins)}"
    for i in range(len(sides)):
        folded = f"SELECT * REPLACE (CASE WHEN m{i} THEN sha256(l{i} || d || r{i}) ELSE d END AS d) FROM ({folded})"
    last = f"""SELECT doc_id, leaf, subroot, s{SOURCE_LEVELS}.h AS root, proof_sha256, d AS folded_root, d = s{SOURCE_LEVELS}.h AS verified
FROM ({folded}), s{SOURCE_LEVELS}"""
    return f"WITH {', '.join(parts)} {last}"


def products_sql() -> str:
    """Whole-number products of every fiftieth vector with all others; doubles hold them exactly."""
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
