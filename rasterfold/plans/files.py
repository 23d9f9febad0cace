"""Queries over encoded files and streams."""

from __future__ import annotations

from rasterfold.operators import analytics
from rasterfold.plans.imaging import AT, Query
from rasterfold.sources import images, tables
from rasterfold.sources.tables import RGBA_SQL
from rasterfold.streaming import telemetry

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

for _kind in images.ENCODERS:
    _alpha = "255 AS a" if _kind == "pnm" else "a"
    QUERIES[f"codec_{_kind}"] = lambda s, d, k=_kind: images.decoded(images.encoded(tables.rgba(s, d), k))
    SQL[f"codec_{_kind}"] = f"WITH {RGBA_SQL} SELECT {AT}, r, g, b, {_alpha} FROM px"
QUERIES["data_uri"] = lambda s, d: images.encoded(tables.rgba(s, d), "bmp").selectExpr("image_id", "length(content) AS bytes", "concat('data:image/bmp;base64,', translate(base64(content), '\\r\\n', '')) AS uri").selectExpr("image_id", "bytes", "length(uri) AS characters")
SQL["data_uri"] = f"WITH {RGBA_SQL} SELECT image_id, CAST(54 + 4 * count(*) AS INT) AS bytes, CAST(22 + 4 * ((54 + 4 * count(*) + 2) // 3) AS INT) AS characters FROM px GROUP BY 1"
QUERIES["identify"] = lambda s, d: images.identify(images.encoded(tables.rgba(s, d), "png")).select("image_id", "format", "width", "height")
SQL["identify"] = f"WITH {RGBA_SQL} SELECT image_id, 'png' AS format, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY 1"
_KEY = b"a key of these tests"
_PADS = [bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
QUERIES["signed_url"] = lambda s, d: analytics.signed(tables.table(s, d, "pages").selectExpr("page_id", "concat(lower(url), '?width=', page_id % 800 + 1) AS canonical"), _KEY)
SQL["signed_url"] = f"""WITH c AS (SELECT page_id, lower(url) || '?width=' || (page_id % 800 + 1) AS canonical FROM pages),
i AS (SELECT *, unhex(sha256(unhex('{_PADS[0]}') || encode(canonical))) AS h FROM c)
SELECT page_id, canonical, canonical || CASE WHEN contains(canonical, '?') THEN '&' ELSE '?' END || 'sig=' || rtrim(translate(base64(unhex(sha256(unhex('{_PADS[1]}') || h))), '+/', '-_'), '=') AS signed FROM i"""
QUERIES["telemetry_stream"] = lambda s, d: telemetry.drained(telemetry.windowed(telemetry.event_stream(s, f"{d}/events.parquet*")))
SQL["telemetry_stream"] = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS begin, event_type AS op, count(*) AS calls, max(value) AS longest FROM events GROUP BY 1, 2"
QUERIES["user_sessions"] = lambda s, d: telemetry.sessions(tables.table(s, d, "events"))
SQL["user_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begin, count(*) AS calls FROM n GROUP BY user_id, k"""
