"""SQL fragments shared by the feature queries."""

HIST = "OVER (PARTITION BY object_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def over(days: int) -> str:
    return f"OVER (PARTITION BY object_id ORDER BY ord RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


def residual(y: str, x: str, source: str, name: str, min_points: int = 15) -> str:
    """SELECT adding the expanding-fit residual ``name`` to a table."""
    both = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    vx, vy = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    return f"""SELECT * EXCLUDE (n_, sx_, sy_, sxx_, sxy_),
      CASE WHEN {both} AND n_ >= {min_points} AND abs(n_ * sxx_ - sx_ * sx_) >= 1e-9 THEN
        {y} - ((sy_ - (n_ * sxy_ - sx_ * sy_) / nullif(n_ * sxx_ - sx_ * sx_, 0) * sx_) / n_
               + (n_ * sxy_ - sx_ * sy_) / nullif(n_ * sxx_ - sx_ * sx_, 0) * {x}) END AS {name}
      FROM (SELECT *, count({vx}) {HIST} AS n_, sum({vx}) {HIST} AS sx_, sum({vy}) {HIST} AS sy_,
                   sum(({vx}) * ({vx})) {HIST} AS sxx_, sum(({vx}) * ({vy})) {HIST} AS sxy_ FROM {source})"""


def robust_z(c: str, floor: float) -> str:
    w = over(30)
    q = [f"quantile_cont({c}, {p}) {w}" for p in (0.25, 0.5, 0.75)]
    return (f"CASE WHEN count({c}) {w} >= 5 AND {c} IS NOT NULL THEN least(greatest("
            f"({c} - {q[1]}) / greatest(({q[2]} - {q[0]}) / 1.349, CAST({floor} AS DOUBLE)), -10), 10) END")


def slope(c: str, days: int) -> str:
    return f"CASE WHEN count({c}) {over(days)} >= 3 THEN regr_slope({c}, CAST(ord AS DOUBLE)) {over(days)} END"


def std(c: str, days: int) -> str:
    return f"CASE WHEN count({c}) {over(days)} >= 3 THEN stddev_samp({c}) {over(days)} END"


def ewm(c: str, span: int, source: str, name: str) -> str:
    """(object_id, ord, name) by the closed form of the adjusted weighted mean over observation numbers."""
    k = 1 - 2 / (span + 1)
    return f"""SELECT a.object_id, a.ord,
      sum(b.{c} * pow({k}, a.rn - b.rn)) / nullif(sum(CASE WHEN b.{c} IS NOT NULL THEN pow({k}, a.rn - b.rn) END), 0) AS {name}
      FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS rn FROM {source}) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS rn FROM {source}) b
        ON a.object_id = b.object_id AND b.rn <= a.rn
      GROUP BY a.object_id, a.ord"""
