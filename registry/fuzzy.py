"""The matching-block ratio and first-match leader clusters as DuckDB common table expressions.

The ratio of a later against an earlier string is 2M/T. M is found by taking the longest common block, the
first one in the later string and there the first in the earlier one, and again so on both sides of it. Strings
here stay below 200 characters, from where on frequent characters would be passed over.
"""

_STEP = 1000  # blocks are compared by length first, then by the smaller start


def _longest(x: str, y: str) -> str:
    """length * _STEP - start of the best block of x in y; null if nothing is shared."""
    piece = f"substr({x}, i, k)"
    inner = f"list_transform(range(1, length({x}) - i + 2), lambda k: CASE WHEN contains({y}, {piece}) THEN k * {_STEP} - i END)"
    return f"list_max(list_transform(range(1, length({x}) + 1), lambda i: list_max({inner})))"


def ratios(pairs: str, name: str = "ratios") -> list[str]:
    """`name` (a, b, ratio) for the distinct (a, b) of a relation; 0 where one of them is blank."""
    return [
        f"{name}_pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')",
        f"""{name}_blocks(a, b, x, y, best) AS (
  SELECT a, b, a, b, {_longest('a', 'b')} FROM {name}_pairs
  UNION ALL
  SELECT a, b, side.x, side.y, {_longest('side.x', 'side.y')} FROM (
    SELECT a, b, unnest([
      {{'x': substr(x, 1, start - 1), 'y': substr(y, 1, place - 1)}}, {{'x': substr(x, start + size), 'y': substr(y, place + size)}}]) AS side
    FROM (SELECT *, strpos(y, substr(x, start, size)) AS place FROM (
      SELECT *, (best + {_STEP - 1}) // {_STEP} AS size, size * {_STEP} - best AS start FROM {name}_blocks WHERE best IS NOT NULL)))
  WHERE side.x <> '' AND side.y <> '')""",
        f"""{name} AS MATERIALIZED (
  SELECT a, b, 2.0::DOUBLE * coalesce(sum((best + {_STEP - 1}) // {_STEP}), 0)::DOUBLE / (length(a) + length(b)) AS ratio FROM {name}_blocks GROUP BY a, b)""",
    ]


def key_ratios(keyed: str) -> list[str]:
    """Ratios of all company keys, and of the title keys whose lengths allow 0.75."""
    return [
        f"ck_all AS (SELECT x.ck AS a, y.ck AS b FROM (SELECT DISTINCT ck FROM {keyed}) x, (SELECT DISTINCT ck FROM {keyed}) y)",
        *ratios("ck_all", "ck_ratio"),
        f"""tk_all AS (SELECT x.tk AS a, y.tk AS b FROM (SELECT DISTINCT tk FROM {keyed}) x, (SELECT DISTINCT tk FROM {keyed}) y
  WHERE 2.0 * least(length(x.tk), length(y.tk)) >= 0.75 * (length(x.tk) + length(y.tk)))""",
        *ratios("tk_all", "tk_ratio"),
    ]


def leaders(keyed: str, mark: str = "") -> list[str]:
    """`nodes`, `edges` and `fuzzy` (the rows of `keyed` with `leader`), names followed by `mark`; needs key_ratios.

    Nodes are walked in order: one without an earlier leader among its matches leads.
    """
    n, e, w = f"nodes{mark}", f"edges{mark}", f"walk{mark}"
    return [
        f"{n} AS MATERIALIZED (SELECT ck, tk, min(ord) AS ord FROM {keyed} WHERE ck <> '' AND tk <> '' GROUP BY ck, tk)",
        f"""{e} AS MATERIALIZED (
  SELECT x.ord AS earlier, y.ord AS later, x.ck AS earlier_ck, x.tk AS earlier_tk, y.ck AS later_ck, y.tk AS later_tk
  FROM (SELECT a, b FROM tk_ratio WHERE ratio >= 0.75) t JOIN {n} y ON y.tk = t.a JOIN {n} x ON x.tk = t.b AND x.ord < y.ord
  JOIN (SELECT a, b FROM ck_ratio WHERE ratio >= 0.8) c ON c.a = y.ck AND c.b = x.ck)""",
        f"""numbered{mark} AS MATERIALIZED (
  SELECT ord, coalesce(prior, []) AS prior, row_number() OVER (ORDER BY ord) AS n
  FROM {n} LEFT JOIN (SELECT later, list(earlier) AS prior FROM {e} GROUP BY later) ON later = ord)""",
        f"""{w}(n, found) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT {w}.n + 1, CASE WHEN list_has_any(prior, found) THEN found ELSE list_append(found, ord) END FROM {w} JOIN numbered{mark} m ON m.n = {w}.n + 1)""",
        f"""fuzzy{mark} AS MATERIALIZED (
  SELECT k.*, coalesce(f.leader, k.ord) AS leader FROM {keyed} k LEFT JOIN (
    SELECT ck, tk, coalesce(list_min(list_intersect(prior, (SELECT found FROM {w} ORDER BY n DESC LIMIT 1))), ord) AS leader
    FROM {n} JOIN numbered{mark} USING (ord)) f USING (ck, tk))""",
    ]
