"""The damage and repair of conversations as one SQL statement, which the query is held against."""

from __future__ import annotations


def repair_sql() -> str:
    """A walk over the rows of all conversations at once that keeps, per state, the cheapest letters and lines, of equal cost the least letters.

    States s0 to s3: nothing yet, after s, after u, after a; t2 and t3 are also reached by way of inserted turns. Two ways
    to one state that cost the same differ in a letter before either ends, so the least letters stay least whatever follows.
    """
    never, start = ("{'cost': %d, 'audit': '', 'lines': []::VARCHAR[]}" % n for n in (1_000_000_000, 0))

    def add(x: str, cost: str, letter: str, line: str = "") -> str:
        lines = f"list_append({x}.lines, {line})" if line else f"{x}.lines"
        return f"{{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{letter}', 'lines': {lines}}}"

    best = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    insert = lambda x, name: add(x, "3", "I", f"'{name}:'")
    drop = lambda x: add(x, "4", "D")
    keep = lambda x, c: f"CASE WHEN free AND c = '{c}' THEN {add(x, 'extra', 'K', 'line')} ELSE {never} END"
    turn = lambda x, name: f"CASE WHEN free THEN {add(x, '3 + extra', 'R', f"'{name}:' || text")} ELSE {never} END"
    two = best("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))
    three = best("s3", insert("t2", "assistant"))
    closed = lambda source: f"(SELECT *, {three} AS t3 FROM (SELECT *, {two} AS t2 FROM {source}))"
    after_u = best(drop("t2"), *[f(x, y) for x in ("s0", "s1", "t3") for f, y in ((keep, "u"), (turn, "user"))])
    after_a = best(drop("t3"), keep("t2", "a"), turn("t2", "assistant"))
    byte = "list_reduce([xor(a, b)] || range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384))"
    step = """(SELECT w.conv_id, f.i, s0, s1, s2, s3, c, text, line, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
      FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)"""
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
  h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(key)), lambda i: ord(key[i + 1])::BIGINT), lambda a, b: {byte}), 4294967295) % 20 AS kind FROM k),
  d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, role[1] AS c, role || ':' || text AS line FROM d),
  f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM r),
  w(conv_id, i, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, 0::BIGINT, {start}, {never}, {never}, {never} FROM f
    UNION ALL SELECT conv_id, i, {drop('s0')}, {best(drop('s1'), keep('s0', 's'))}, {after_u}, {after_a} FROM {closed(step)}),
  n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (was IS NOT NULL AND was || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
  e AS (SELECT n.*, {best('s0', 't3')} AS x FROM {closed('w')} v JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.i = n.n)
  SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.cost, 0)::BIGINT AS cost,
    coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.lines, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"""
