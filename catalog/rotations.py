"""Eigenvalues and eigenvectors of symmetric matrices in SQL, by cyclic rotations."""

from __future__ import annotations

SWEEPS = 10


def eigen_cte(name: str, cells: str, d: int) -> str:
    """CTEs up to ``name``: side, component, value and axis (a list) for each matrix of ``cells``.

    ``cells``: a query of (side, i, j, x) for all 0-based i and j below ``d``. Each step
    turns one off-diagonal cell to zero; ``SWEEPS`` rounds over all of them leave
    nothing but rounding. Components go by descending value; the largest entry of an
    axis is positive (the first of those within rounding of it).
    """
    pairs = [(p, q) for p in range(d) for q in range(p + 1, d)]
    listed = ", ".join(f"{{'p': {p}, 'q': {q}}}" for p, q in pairs)

    def columns(m: str) -> str:
        """The matrix ``m`` times the rotation."""
        return (
            f"list_transform(range({d * d}), lambda e: CASE WHEN e % {d} = p THEN c * {m}[e // {d} * {d} + p + 1] - s * {m}[e // {d} * {d} + q + 1] "
            f"WHEN e % {d} = q THEN s * {m}[e // {d} * {d} + p + 1] + c * {m}[e // {d} * {d} + q + 1] ELSE {m}[e + 1] END)"
        )

    rows = (
        f"list_transform(range({d * d}), lambda e: CASE WHEN e // {d} = p THEN c * b[p * {d} + e % {d} + 1] - s * b[q * {d} + e % {d} + 1] "
        f"WHEN e // {d} = q THEN s * b[p * {d} + e % {d} + 1] + c * b[q * {d} + e % {d} + 1] ELSE b[e + 1] END)"
    )
    tangent = (
        "CASE WHEN apq = 0 THEN 0 ELSE (CASE WHEN aqq >= app THEN 1 ELSE -1 END) / "
        "(abs((aqq - app) / (2 * apq)) + sqrt(1 + ((aqq - app) / (2 * apq)) ** 2)) * sign(apq) END"
    )
    unit = ", ".join("1.0::DOUBLE" if e % (d + 1) == 0 else "0.0::DOUBLE" for e in range(d * d))
    return f"""
    {name}_cells AS ({cells}),
    {name}_turned AS (
      WITH RECURSIVE turned AS (
        SELECT side, 0 AS step, list(x::DOUBLE ORDER BY i, j) AS a, [{unit}] AS v FROM {name}_cells GROUP BY side
        UNION ALL
        SELECT side, step + 1, {rows} AS a, v FROM (
          SELECT side, step, p, q, c, s, {columns('a')} AS b, {columns('v')} AS v FROM (
            SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
              SELECT *, {tangent} AS t FROM (
                SELECT *, a[p * {d + 1} + 1] AS app, a[q * {d + 1} + 1] AS aqq, a[p * {d} + q + 1] AS apq FROM (
                  SELECT *, x.p AS p, x.q AS q FROM (SELECT *, [{listed}][step % {len(pairs)} + 1] AS x FROM turned))))))
        WHERE step < {SWEEPS * len(pairs)})
      SELECT side, a, v FROM turned WHERE step = {SWEEPS * len(pairs)}),
    {name}_found AS (
      SELECT side, greatest(a[k * {d + 1} + 1], 0) AS value, list_transform(range({d}), lambda e: v[e * {d} + k + 1]) AS raw
      FROM {name}_turned, (SELECT unnest(range({d})) AS k)),
    {name}_signed AS (
      SELECT side, value, raw, list_max(list_transform(raw, lambda x: abs(x))) AS most FROM {name}_found),
    {name} AS (
      SELECT side, row_number() OVER (PARTITION BY side ORDER BY value DESC) AS component, value,
             list_transform(raw, lambda x: x * sign(list_filter(raw, lambda y: abs(y) >= most * (1 - 1e-9))[1])) AS axis
      FROM {name}_signed)"""
