"""Pieces of DuckDB SQL for the counterparts of the queries."""

from __future__ import annotations

#: Gray 8-bit frames of embeddings, a row a sample.
E8 = "e8 AS (SELECT n, 0 AS plane, i // 8 AS y, i % 8 AS x, CAST(round_even(least(greatest((CAST(e AS DOUBLE) + 0.6) * 212.5, 0), 255), 0) AS BIGINT) AS v FROM (SELECT vec_id AS n, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
#: The same as floats.
EF = "ef AS (SELECT n, 0 AS plane, i // 8 AS y, i % 8 AS x, e AS v FROM (SELECT vec_id AS n, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
#: Three embeddings a frame.
R8 = E8 + ", r8 AS (SELECT n // 3 AS n, n % 3 AS plane, y, x, v FROM e8 WHERE n < (SELECT count(*) // 3 * 3 FROM embeddings))"
#: The second and third of them halved.
Y8 = R8 + ", y8 AS (SELECT * FROM r8 WHERE plane = 0 UNION ALL SELECT n, plane, y // 2, x // 2, v FROM r8 WHERE plane > 0 AND y % 2 = 0 AND x % 2 = 0)"
#: Each sample with its frame's list.
G8 = E8 + ", f8 AS (SELECT n, plane, list(v ORDER BY y, x) AS d FROM e8 GROUP BY n, plane), g8 AS (SELECT e8.*, d FROM e8 JOIN f8 USING (n, plane))"
#: Stereo samples of events.
A16 = "a AS (SELECT event_id AS s, 0 AS ch, CAST(round_even(least(greatest(value * 66, -32768), 32767), 0) AS BIGINT) AS v FROM events UNION ALL SELECT event_id, 1, (user_id - 75) * 200 FROM events)"
#: Properties of the gray frames.
P8 = "p AS (SELECT vec_id AS n, CAST(label AS BIGINT) AS label, CAST(coalesce(label <> lag(label) OVER (ORDER BY vec_id), false) AS BIGINT) AS prev, CAST(coalesce(label <> lead(label) OVER (ORDER BY vec_id), false) AS BIGINT) AS next FROM embeddings)"
COUNT = "(SELECT count(*) FROM embeddings)"
EVENTS = "(SELECT count(*) FROM events)"


def video(base: str, select: str, frm: str, is_float: bool = False, where: str = "", places: int = 4) -> str:
    """select: `n, plane, y, x, v` expressions."""
    v = f"round(CAST(v AS DOUBLE), {places})" if is_float else "CAST(v AS BIGINT)"
    return f"WITH {base} SELECT CAST(n AS BIGINT) AS n, CAST(plane AS BIGINT) AS plane, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {v} AS v FROM (SELECT {select} FROM {frm}{' WHERE ' + where if where else ''})"


def point(expression: str, base: str = E8, frm: str = "e8", is_float: bool = False) -> str:
    return video(base, f"n, plane, y, x, {expression} AS v", frm, is_float)


def tap(dy: int, dx: int, mirror: bool = False) -> str:
    if mirror:
        at = lambda p: f"CASE WHEN {p} < 0 THEN -({p}) - 1 WHEN {p} > 7 THEN 15 - ({p}) ELSE {p} END"
    else:
        at = lambda p: f"least(greatest({p}, 0), 7)"
    return f"d[({at(f'y + {dy}')}) * 8 + ({at(f'x + {dx}')}) + 1]"


AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def near(expression: str) -> str:
    return video(G8, f"n, plane, y, x, {expression} AS v", "g8")


def taps(*more: str) -> str:
    return ", ".join([*more, *(tap(*d) for d in AROUND)])


def convolved(matrix: list[int], divisor: float, bias: float = 0, saturate: bool = True, places=None, mirror: bool = False) -> str:
    places = places or [(k // 3 - 1, k % 3 - 1) for k in range(9)]
    acc = " + ".join(f"({c}) * {tap(*d, mirror)}" for c, d in zip(matrix, places, strict=True))
    x = f"CAST(CAST(CAST({acc} AS FLOAT) * CAST({1 / divisor!r} AS FLOAT) AS FLOAT) + CAST({bias} AS FLOAT) AS FLOAT)"
    x = x if saturate else f"abs({x})"
    return near(f"least(greatest(round_even(CAST({x} AS DOUBLE), 0), 0), 255)")


def edges(middle: int) -> str:
    gx = f"({tap(-1, 1)} + {middle} * {tap(0, 1)} + {tap(1, 1)} - {tap(-1, -1)} - {middle} * {tap(0, -1)} - {tap(1, -1)})"
    gy = f"({tap(1, -1)} + {middle} * {tap(1, 0)} + {tap(1, 1)} - {tap(-1, -1)} - {middle} * {tap(-1, 0)} - {tap(-1, 1)})"
    return near(f"least(round_even(CAST(CAST(sqrt(CAST({gx} * {gx} + {gy} * {gy} AS DOUBLE)) AS FLOAT) AS DOUBLE), 0), 255)")


def resampled(frames: str, source: str, where: str = "") -> str:
    """frames: SQL of (n, src): which frame of `source` stands at n."""
    return video(E8, "m.n, plane, y, x, v", f"({frames}) m JOIN {source} ON {source}.n = m.src{' WHERE ' + where if where else ''}")


def pair(expression: str, b: str, base: str = E8, is_float: bool = False, a: str = "e8") -> str:
    """b: SQL of the second clip's samples over the same frames; expression over a.v and b.v."""
    return video(base, f"a.n, a.plane, a.y, a.x, {expression} AS v", f"{a} a JOIN ({b}) b ON a.n = b.n AND a.plane = b.plane AND a.y = b.y AND a.x = b.x", is_float)


#: The gray clip backwards, and its first 100 frames held to the end.
BACK = f"SELECT {COUNT} - 1 - n AS n, plane, y, x, v FROM e8"
HELD = f"SELECT m.n, plane, y, x, v FROM (SELECT range AS n, least(range, 99) AS src FROM range({COUNT})) m JOIN e8 ON e8.n = m.src"


def audio(base: str, select: str, frm: str, where: str = "") -> str:
    return f"WITH {base} SELECT CAST(s AS BIGINT) AS s, CAST(ch AS BIGINT) AS ch, CAST(v AS BIGINT) AS v FROM (SELECT {select} FROM {frm}{' WHERE ' + where if where else ''})"


def away(x: str) -> str:
    """Rounded half away from zero and held in 16 bits."""
    return f"least(greatest(sign({x}) * floor(abs({x}) + 0.5), -32768), 32767)"


def scaled(across: list, down: list, w: int, h: int) -> str:
    """Gray frames scaled by tap tables."""
    values = lambda t: ", ".join(f"({i}, {k}, {weight!r}::DOUBLE)" for i, row in enumerate(t) for k, weight in row)
    base = E8 + f", tx(o, k, w) AS (VALUES {values(across)}), ty(o, k, w) AS (VALUES {values(down)})"
    base += ", hx AS (SELECT n, y, o AS x, sum(CAST(v AS DOUBLE) / 255.0 * w) AS v FROM e8 JOIN tx ON k = x GROUP BY n, y, o), hy AS (SELECT n, o AS y, x, sum(v * w) AS v FROM hx JOIN ty ON k = y GROUP BY n, x, o)"
    return video(base, "n, 0 AS plane, y, x, least(greatest(round_even(round(v * 255.0, 6), 0), 0), 255) AS v", "hy")


def sited(across: list, down: list) -> str:
    """Tables up to m: the first plane of y8 as a mask for each plane, chroma's scaled by tap tables."""
    values = lambda t: ", ".join(f"({i}, {k}, {weight!r}::DOUBLE)" for i, row in enumerate(t) for k, weight in row)
    base = f"tx(o, k, w) AS (VALUES {values(across)}), ty(o, k, w) AS (VALUES {values(down)})"
    base += ", hx AS (SELECT n, y, o AS x, sum(CAST(v AS DOUBLE) * w) AS v FROM y8 JOIN tx ON k = x WHERE plane = 0 GROUP BY n, y, o), hy AS (SELECT n, o AS y, x, sum(v * w) AS v FROM hx JOIN ty ON k = y GROUP BY n, x, o)"
    return base + ", m AS (SELECT n, 0 AS plane, y, x, v FROM y8 WHERE plane = 0 UNION ALL SELECT n, p, y, x, CAST(least(greatest(round_even(round(v, 6), 0), 0), 255) AS BIGINT) FROM hy, (SELECT unnest([1, 2]) AS p))"
