"""DuckDB SQL equivalents of the registered queries, over the same tables.

Written on their own terms: sequences per whole source instead of spans,
running counts and numbers in one window instead of pieces, 64-bit hashes in
128-bit integers.
"""

from __future__ import annotations


def _ip(column: str) -> str:
    parts = [f"(({column} >> {s}) & 255)" for s in (24, 16, 8, 0)]
    return " || '.' || ".join(parts)


SYN = "(flags & 1) <> 0 AND (flags & 2) = 0"
WIN = "(timestamp_ms - timestamp_ms % 5000)"
ARRIVAL = "timestamp_ms, packet_id, stage, match_end, match_pos, rule_name"
ARRIVAL_DESC = ", ".join(c + " DESC" for c in ARRIVAL.split(", "))
ALERT_COLUMNS = ("timestamp_ms, rule_name, severity, src_ip, dst_ip, detail, detector, "
                 "packet_id, stage, match_pos, match_end")

# --- derived tables, as common table expressions by name ----------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def _with(body: str, *needs: str) -> str:
    """The query preceded by the tables it needs, each once and in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


_cte("base", """
  SELECT event_id, event_type, user_id, epoch_us(ts) // 1000 AS t0,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events""")

_cte("shapes", """
  SELECT event_id, user_id, 0 AS slot, t0 AS timestamp_ms,
         CASE event_id % 4 WHEN 0 THEN 8080 WHEN 1 THEN 8443 WHEN 2 THEN 2222 ELSE 853 END AS dst_port,
         3 AS flags, 'HEAD /status HTTP/1.0' AS payload
  FROM base
  UNION ALL
  SELECT event_id, user_id, 100 + i, t0 + 10 * i, 80, 1, ''
  FROM (SELECT *, unnest(range(0, 30 + k % 60)) AS i FROM base
        WHERE event_type = 'error' AND event_id % 5 = 0)
  UNION ALL
  SELECT event_id, user_id, 300 + i, t0 + 10 * i, 2000 + 11 * i, 1, ''
  FROM (SELECT *, unnest(range(0, 15 + k % 30)) AS i FROM base
        WHERE event_type = 'signup' AND event_id % 5 = 1)
  UNION ALL
  SELECT event_id, user_id, 500, t0 + 1, 80, 3,
         CASE k % 6 WHEN 0 THEN 'POST /files?name=../../etc/passwd' WHEN 1 THEN 'q=9'' UNION SELECT name'
                    WHEN 2 THEN 'say <script>alert(''hi'')</script>' WHEN 3 THEN 'start cmd.exe /q'
                    WHEN 4 THEN 'PUT /a/../../../b' ELSE 'union select name' END
  FROM base WHERE event_type = 'click' AND event_id % 5 = 2
  UNION ALL
  SELECT event_id, user_id, 600 + i, t0 + 1 + i, 80, 1, ''
  FROM (SELECT *, unnest(range(0, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS i FROM base
        WHERE event_type = 'purchase' AND event_id % 5 = 3)
  UNION ALL
  SELECT event_id, user_id, 700 + i, t0 + 1 + (k % 8) * 1000 + i, 80, 3,
         'POST /files?name=../../etc/passwd'
  FROM (SELECT *, unnest(range(0, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS i FROM base
        WHERE event_type = 'purchase' AND event_id % 5 = 3)""", "base")

_cte("packets", """
  SELECT CAST(event_id * 1000 + slot AS BIGINT) AS packet_id,
         CAST(timestamp_ms AS BIGINT) AS timestamp_ms,
         CAST(2886729728 + user_id AS BIGINT) AS src_ip, CAST(3325256714 AS BIGINT) AS dst_ip,
         CAST(1024 + (event_id * 1000 + slot) % 64511 AS INTEGER) AS src_port,
         CAST(dst_port AS INTEGER) AS dst_port, 'Tcp' AS protocol,
         CAST(flags AS INTEGER) AS flags, payload
  FROM shapes""", "shapes")

# The default rules' names, patterns and severities.
_cte("rules", """
  SELECT * FROM (VALUES
    ('path-traversal-passwd', '/etc/passwd', 'High'),
    ('sql-injection-union', 'UNION SELECT', 'High'),
    ('xss-script-tag', '<script>alert(', 'Medium'),
    ('windows-cmd-exec', 'cmd.exe', 'Critical'),
    ('path-traversal-generic', '../../', 'Medium')) AS r(rule_name, pattern, severity)""")

_cte("hits", """
  SELECT p.*, r.rule_name, r.severity, r.pattern, pos
  FROM packets p
  JOIN rules r ON contains(p.payload, r.pattern),
  LATERAL (SELECT unnest(range(1, length(p.payload) - length(r.pattern) + 2)) AS pos) s
  WHERE substr(p.payload, pos, length(r.pattern)) = r.pattern""", "packets", "rules")

_cte("sig", f"""
  SELECT timestamp_ms, rule_name, severity, {_ip('src_ip')} AS src_ip, {_ip('dst_ip')} AS dst_ip,
         'signature match for rule ''' || rule_name || ''' in payload sample' AS detail,
         'Signature' AS detector, packet_id, 1 AS stage, CAST(pos AS INTEGER) AS match_pos,
         CAST(pos + length(pattern) - 1 AS INTEGER) AS match_end
  FROM hits""", "hits")


def _anomaly(rule: str, severity: str, detail: str, stage: int, source: str) -> str:
    return f"""
  SELECT timestamp_ms, '{rule}' AS rule_name, '{severity}' AS severity,
         {_ip('src_ip')} AS src_ip, {_ip('dst_ip')} AS dst_ip,
         'source ' || {_ip('src_ip')} || {detail} AS detail,
         'Anomaly' AS detector, packet_id, {stage} AS stage, 0 AS match_pos, 0 AS match_end
  FROM {source}"""


_cte("flood", _anomaly("syn-flood-anomaly", "Critical",
                       "' sent an estimated 50+ SYNs within 5s window'", 2, f"""(
    SELECT *, row_number() OVER (PARTITION BY src_ip, {WIN} ORDER BY timestamp_ms, packet_id) AS n
    FROM packets WHERE {SYN})
  WHERE n = 50"""), "packets")

_cte("scan", _anomaly("port-scan-anomaly", "High",
                      "' touched an estimated 25 distinct destination ports within 5s window'", 3, f"""(
    SELECT *, sum(fresh) OVER (PARTITION BY src_ip, {WIN} ORDER BY timestamp_ms, packet_id) AS n
    FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, {WIN}, dst_port
                                                 ORDER BY timestamp_ms, packet_id) = 1
                         THEN 1 ELSE 0 END AS fresh FROM packets))
  WHERE fresh = 1 AND n = 25"""), "packets")


def _brackets(rows: str, key: str, time: str, within: int) -> str:
    """Two-step matches: rows(key, time, tie, o, x, …) with x = 1 first, -1 second."""
    order = f"ORDER BY {time}, tie, o"
    return f"""
  SELECT *, CAST({time} - first_time AS BIGINT) AS age FROM (
    SELECT *, last_value(CASE WHEN x = 1 THEN {time} END IGNORE NULLS)
                OVER (PARTITION BY {key}, lvl {order}) AS first_time
    FROM (
      SELECT *, CASE WHEN x = 1 THEN d ELSE pd END AS lvl
      FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY {key} {order}), 0) AS pd
            FROM (SELECT *, s - least(0, min(s) OVER (PARTITION BY {key} {order})) AS d
                  FROM (SELECT *, sum(x) OVER (PARTITION BY {key} {order}) AS s FROM ({rows}))))
      WHERE x = 1 OR pd > 0))
  WHERE x = -1 AND {time} - first_time <= {within}"""


_cte("matches", _brackets(f"""
      SELECT *, packet_id AS tie, 0 AS o, -1 AS x FROM packets WHERE contains(payload, 'passwd')
      UNION ALL
      SELECT *, packet_id AS tie, 1 AS o, 1 AS x FROM packets WHERE {SYN}""",
                          "src_ip", "timestamp_ms", 5000), "packets")

_cte("repeats", _brackets("""
      SELECT *, packet_id AS tie, 0 AS o, -1 AS x FROM packets WHERE contains(payload, 'passwd')
      UNION ALL
      SELECT *, packet_id AS tie, 1 AS o, 1 AS x FROM packets WHERE contains(payload, 'passwd')""",
                          "src_ip", "timestamp_ms", 8000), "packets")

_cte("high_ports", _brackets(f"""
      SELECT *, packet_id AS tie, 0 AS o, -1 AS x FROM packets WHERE dst_port > 8000
      UNION ALL
      SELECT *, packet_id AS tie, 1 AS o, 1 AS x FROM packets WHERE {SYN}""",
                             "src_ip", "timestamp_ms", 60000), "packets")

_cte("seq", f"""
  SELECT timestamp_ms, 'probe-then-exploit-attempt' AS rule_name, 'Critical' AS severity,
         {_ip('src_ip')} AS src_ip, {_ip('dst_ip')} AS dst_ip,
         'CEP rule ''probe-then-exploit-attempt'' completed: 2 steps matched within 5s' AS detail,
         'Cep' AS detector, packet_id, 4 AS stage, 0 AS match_pos, 0 AS match_end
  FROM matches""", "matches")

_cte("alerts", " UNION ALL ".join(f"SELECT {ALERT_COLUMNS} FROM {t}" for t in ("sig", "flood", "scan", "seq")),
     "sig", "flood", "scan", "seq")

_cte("numbered", f"""
  SELECT row_number() OVER (PARTITION BY detector ORDER BY {ARRIVAL}) AS id, * FROM alerts""", "alerts")

_cte("days", """
  SELECT (t0 // 86400000 + 1) * 86400000 AS poll_ms, count(*) AS n,
         count(*) FILTER (WHERE k = 0) AS dropped, count(*) FILTER (WHERE event_type = 'error') AS alerting
  FROM base GROUP BY 1""", "base")

_cte("polls", """
  SELECT poll_ms, CAST(sum(n) OVER w AS BIGINT) AS events_processed,
         CAST(sum(dropped) OVER w AS BIGINT) AS events_dropped,
         CAST(sum(alerting) OVER w AS BIGINT) AS alerts_fired
  FROM days WINDOW w AS (ORDER BY poll_ms)""", "days")

_cte("stats", """
  SELECT 'r0' AS run_id, CAST(poll_ms AS DOUBLE) / 1000 AS poll_time, events_processed, events_dropped,
         alerts_fired, events_dropped AS queue_backpressure_events
  FROM (SELECT * FROM polls UNION ALL
        SELECT poll_ms + 3600000, events_processed, events_dropped, alerts_fired
        FROM polls WHERE poll_ms = (SELECT min(poll_ms) FROM polls))""", "polls")

_cte("growth", """
  SELECT *, poll_time - lag(poll_time) OVER w AS dt,
         events_processed - lag(events_processed) OVER w AS de,
         events_dropped - lag(events_dropped) OVER w AS dd
  FROM stats WINDOW w AS (PARTITION BY run_id ORDER BY poll_time)""", "stats")

_cte("rates", "SELECT *, de / dt AS eps FROM growth", "growth")


def _h(column: str, digits: int) -> str:
    return f"lpad(to_hex({column}), {digits}, '0')"


_PORTS = f"{_h('src_port', 4)} || {_h('dst_port', 4)}"
_TCP = f"({_PORTS} || repeat('00', 9) || {_h('flags', 2)} || repeat('00', 6))"
_UDP = f"({_PORTS} || '00080000')"
_MACS = "'020000000001020000000002'"


def _iphdr(version: str, protocol: str, options: str = "") -> str:
    return (f"'{version}' || repeat('00', 8) || '{protocol}0000' || {_h('src_ip', 8)} || "
            f"{_h('dst_ip', 8)} || '{options}'")


_cte("frames", f"""
  SELECT packet_id AS frame_id, CAST(packet_id % 4 AS INTEGER) AS rx_queue, {_MACS} || CASE packet_id % 11
    WHEN 0 THEN '0800' || {_iphdr('45', '06')} || {_TCP} || hex(payload)
    WHEN 1 THEN '0800' || {_iphdr('45', '11')} || {_UDP} || hex(payload)
    WHEN 2 THEN '0800' || {_iphdr('45', '01')}
    WHEN 3 THEN '0800' || {_iphdr('46', '06', '00000000')} || {_TCP} || hex(payload)
    WHEN 4 THEN '08'
    WHEN 5 THEN '86dd' || {_iphdr('60', '06')} || {_TCP} || hex(payload)
    WHEN 6 THEN '810000010800' || {_iphdr('45', '06')} || {_TCP} || hex(payload)
    WHEN 7 THEN '0800' || '45' || repeat('00', 18)
    WHEN 8 THEN '0800' || {_iphdr('45', '06')} || left({_TCP}, 38)
    WHEN 9 THEN '0800' || {_iphdr('45', '11')} || left({_UDP}, 14)
    ELSE '0800' || {_iphdr('46', '06')} || {_TCP} END AS hexed
  FROM packets""", "packets")

_cte("admission", """
  SELECT frame_id, rx_queue,
         length(hexed) // 2 >= 34 AND substr(hexed, 25, 4) = '0800'
         AND length(hexed) // 2 >= CASE substr(hexed, 47, 2)
               WHEN '06' THEN 14 + 4 * CAST('0x' || substr(hexed, 30, 1) AS INTEGER) + 20
               WHEN '11' THEN 14 + 4 * CAST('0x' || substr(hexed, 30, 1) AS INTEGER) + 8
               ELSE 34 END AS admitted
  FROM frames""", "frames")

_cte("syns", f"SELECT *, {WIN} AS window_start_ms FROM packets WHERE {SYN}", "packets")
_cte("syn_counts", """
  SELECT src_ip, window_start_ms, count(*) AS n_syn FROM syns GROUP BY src_ip, window_start_ms""", "syns")
_cte("hashes", """
  SELECT * FROM (VALUES (0, 373587883, 911), (1, 679295311, 36007), (2, 899809363, 500009),
                        (3, 982451653, 7919)) AS h(cms_row, a, b)""")


def _cell(key: str) -> str:
    return f"CAST((CAST({key} AS HUGEINT) * a + b) % 2147483647 % 2048 AS INTEGER)"


_cte("cells", f"""
  SELECT window_start_ms, cms_row, {_cell('src_ip')} AS cell, CAST(count(*) AS BIGINT) AS n_cell
  FROM syns, hashes GROUP BY ALL""", "syns", "hashes")
_cte("estimates", f"""
  SELECT src_ip, window_start_ms, n_syn, min(n_cell) AS n_estimate
  FROM (SELECT s.*, cms_row, {_cell('src_ip')} AS cell FROM syn_counts s, hashes) k
  JOIN cells USING (window_start_ms, cms_row, cell)
  GROUP BY ALL""", "syn_counts", "cells", "hashes")
_cte("running_cells", f"""
  SELECT packet_id, timestamp_ms, src_ip, dst_ip, window_start_ms, min(n) AS est
  FROM (SELECT s.*, count(*) OVER (PARTITION BY window_start_ms, cms_row, {_cell('src_ip')}
                                   ORDER BY timestamp_ms, packet_id) AS n
        FROM syns s, hashes)
  GROUP BY ALL""", "syns", "hashes")
_cte("cms_alerts", _anomaly("syn-flood-anomaly", "Critical",
                            "' sent an estimated ' || est || '+ SYNs within 5s window'", 2, """(
    SELECT *, row_number() OVER (PARTITION BY src_ip, window_start_ms ORDER BY timestamp_ms, packet_id) AS n
    FROM running_cells WHERE est >= 50)
  WHERE n = 1"""), "running_cells")

# md5 bits: 12 in front (10 for the bucket, 2 spare), 52 behind.
_cte("ports", """
  SELECT *, (timestamp_ms - timestamp_ms % 5000) AS window_start_ms,
         CAST('0x' || substr(md5(CAST(dst_port AS VARCHAR)), 1, 3) AS BIGINT) AS dh,
         CAST('0x' || substr(md5(CAST(dst_port AS VARCHAR)), 4, 13) AS BIGINT) AS dt,
         CAST('0x' || substr(md5(CAST(src_port AS VARCHAR)), 1, 3) AS BIGINT) AS sh,
         CAST('0x' || substr(md5(CAST(src_port AS VARCHAR)), 4, 13) AS BIGINT) AS st
  FROM packets""", "packets")


def _hll(keys: str, head: str, tail: str, textbook: bool = False) -> str:
    rest = f"(({head} & 3) * 4503599627370496 + {tail})"
    linear = "1024 * ln(1024 / (1024 - used))"
    raw = "0.7213 / (1 + 1.079 / 1024) * 1048576 / (1024 - used + inv)"
    extra = f""",
         round(CASE WHEN used < 1024 AND {raw} <= 2560 THEN {linear} ELSE {raw} END, 6) AS n_textbook"""
    return f"""
  SELECT {keys}, round(CASE WHEN (1024 - used) / 1024 > 0.9 THEN {linear} ELSE {raw} END, 6)
         AS n_estimate{extra if textbook else ''}
  FROM (SELECT {keys}, CAST(count(*) AS DOUBLE) AS used, sum(pow(2.0, -rank)) AS inv
        FROM (SELECT {keys}, {head} // 4 AS bucket,
                     max(CASE WHEN {rest} = 0 THEN 55 ELSE 55 - length(bin({rest})) END) AS rank
              FROM ports GROUP BY {keys}, bucket)
        GROUP BY {keys})"""


_cte("bucket_scan", _anomaly("port-scan-anomaly", "High",
                             "' touched an estimated 25 distinct destination ports within 5s window'", 3, """(
    SELECT *, sum(fresh) OVER (PARTITION BY src_ip, window_start_ms ORDER BY timestamp_ms, packet_id) AS n
    FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, window_start_ms, dh // 4
                                                 ORDER BY timestamp_ms, packet_id) = 1
                         THEN 1 ELSE 0 END AS fresh FROM ports))
  WHERE fresh = 1 AND n = 25"""), "ports")


def _hash(octets: list[str]) -> str:
    items = ", ".join(["1469598103934665603::HUGEINT"] + [f"({o})::HUGEINT" for o in octets])
    return (f"list_reduce([{items}], lambda h, o: (xor(h, o) * 1099511628211::HUGEINT) "
            "% 18446744073709551616::HUGEINT)")


def _octets(column: str, n: int) -> list[str]:
    return [f"({column} >> {8 * i}) & 255" for i in reversed(range(n))]


def _hex16(value: str) -> str:
    return f"lpad(lower(to_hex(CAST({value} AS UBIGINT))), 16, '0')"


_FLOW = _hash(_octets("src_ip", 4) + _octets("dst_ip", 4) + _octets("src_port", 2) + _octets("dst_port", 2))
_SHARD = _hash(_octets("src_ip", 4))
_JSON_FIELDS = ", ".join(f"'{c}': {c}" for c in (
    "id", "timestamp_ms", "rule_name", "severity", "src_ip", "dst_ip", "detail", "detector"))
_RANK = "CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 END"


def _catalogue(rows: list[tuple[str, str, str]]) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ") AS c(name, detector, description)"


# The published rule catalogue, and the active rules it leaves out.
_PUBLISHED = [
    ("path-traversal-passwd", "signature", "Aho-Corasick match on '/etc/passwd' in payload sample"),
    ("sql-injection-union", "signature", "Aho-Corasick match on 'UNION SELECT' in payload sample"),
    ("syn-flood-anomaly", "anomaly",
     "Count-Min Sketch estimated SYN count per source exceeds threshold within window"),
    ("port-scan-anomaly", "anomaly",
     "HyperLogLog estimated distinct destination ports per source exceeds threshold within window"),
    ("probe-then-exploit-attempt", "cep",
     "NFA sequence: SYN probe followed by known-bad payload from same source within 5s window"),
]
_REST = [("xss-script-tag", "signature", ""), ("windows-cmd-exec", "signature", ""),
         ("path-traversal-generic", "signature", "")]

_ALERTS = f"SELECT {ALERT_COLUMNS} FROM "

def _reset(body: str) -> str:
    """Reset windows per source, one after the other; ``placed`` has the SYNs with theirs."""
    tables = """times AS (SELECT DISTINCT src_ip, timestamp_ms AS t FROM packets),
        begun AS (
          SELECT src_ip, min(t) AS window_start_ms FROM times GROUP BY src_ip
          UNION ALL
          SELECT b.src_ip, min(t) FROM begun b JOIN times x ON x.src_ip = b.src_ip AND t >= window_start_ms + 5000
          GROUP BY b.src_ip, window_start_ms
        ),
        placed AS (SELECT s.*, b.window_start_ms FROM (SELECT * EXCLUDE window_start_ms FROM syns) s ASOF JOIN begun b
                   ON s.src_ip = b.src_ip AND s.timestamp_ms >= b.window_start_ms)"""
    needs = _with("SELECT 1", "syns")
    return needs.removesuffix("SELECT 1").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + tables + "\n" + body


ORACLE = {
    "all_alerts": _with(_ALERTS + "alerts", "alerts"),
    "all_alerts_staged": _with(_ALERTS + "alerts", "alerts"),
    "event_scan": _with("""SELECT packet_id, timestamp_ms, src_ip, dst_ip, src_port, dst_port, protocol,
        flags, payload AS payload_sample FROM packets""", "packets"),
    "alerts_csv_roundtrip": _with("""SELECT id, timestamp_ms, rule_name, severity, src_ip, dst_ip, detail,
        detector, timestamp_ms AS ts_ms FROM numbered""", "numbered"),
    "stats_scan": _with("""SELECT run_id, poll_time, events_processed, events_dropped, alerts_fired,
        queue_backpressure_events, CAST(poll_time * 1000 AS BIGINT) AS ts_ms FROM stats""", "stats"),
    "incremental_capture": _with(f"""SELECT CAST((timestamp_ms // 86400000 + 1) * 86400000 AS BIGINT) AS poll_ms,
        id, detector, rule_name, timestamp_ms, src_ip FROM numbered""", "numbered"),
    "alerts_json": _with(f"""SELECT detector, id, CAST(to_json({{{_JSON_FIELDS}}}) AS VARCHAR) AS alert_json
        FROM numbered""", "numbered"),
    "rule_catalogue": _with(f"""SELECT name, c.detector, description, count(a.rule_name) AS n_alerts
        FROM {_catalogue(_PUBLISHED)} LEFT JOIN alerts a ON a.rule_name = name GROUP BY ALL""", "alerts"),
    "rule_catalogue_complete": _with(f"""SELECT name, c.detector, count(a.rule_name) AS n_alerts
        FROM {_catalogue(_PUBLISHED + _REST)} LEFT JOIN alerts a ON a.rule_name = name GROUP BY ALL""", "alerts"),
    "ip_to_string": _with(f"""SELECT packet_id, {_ip('src_ip')} AS src, {_ip('dst_ip')} AS dst
        FROM packets""", "packets"),
    "is_syn": _with(f"SELECT packet_id, {SYN} AS is_syn FROM packets", "packets"),
    "tcp_flags": _with("""SELECT packet_id, (flags & 1) > 0 AS syn, (flags & 2) > 0 AS ack,
        (flags & 4) > 0 AS fin, (flags & 8) > 0 AS rst FROM packets""", "packets"),
    "flow_key": _with(f"""SELECT packet_id, {_hex16(_FLOW)} AS flow_key, {_hex16(_SHARD)} AS shard_key
        FROM packets""", "packets"),
    "shard_load": _with(f"""SELECT CAST({_SHARD} % 4 AS INTEGER) AS shard, count(*) AS n_events
        FROM packets GROUP BY 1""", "packets"),
    "epoch_to_ts": _with("""SELECT packet_id,
        strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts_text,
        timestamp_ms AS from_seconds_ms FROM packets""", "packets"),
    "payload_marker": _with("""SELECT packet_id, payload <> '' AND contains(payload, 'passwd') AS has_marker
        FROM packets""", "packets"),
    "severity_rank": _with(f"""SELECT detector, rule_name, packet_id, match_pos, severity,
        {_RANK} AS severity_rank FROM alerts""", "alerts"),
    "port_above": _with("SELECT packet_id, dst_port FROM packets WHERE dst_port > 1023", "packets"),
    "triage_filter": _with(
        _ALERTS + "alerts WHERE severity = 'High' AND detector = 'Signature'", "alerts"),
    "frame_admission": _with("SELECT frame_id, rx_queue, admitted FROM admission", "admission"),
    "frame_counters": _with("""SELECT count(*) FILTER (WHERE NOT admitted) AS n_rejected,
        count(*) FILTER (WHERE admitted) AS n_admitted FROM admission""", "admission"),
    "signature_alerts": _with(_ALERTS + "sig", "sig"),
    "signature_match_count": _with("""SELECT packet_id, rule_name, count(*) AS n_matches
        FROM hits GROUP BY ALL""", "hits"),
    # Neither pattern can overlap itself, so splitting at it finds every occurrence.
    "signature_pages": """
        SELECT page_id, rule_name, CAST(before + 1 AS INTEGER) AS match_pos,
               CAST(before + length(pattern) AS INTEGER) AS match_end
        FROM (SELECT page_id, rule_name, pattern,
                     list_sum(list_transform(parts[1:i], lambda p: strlen(p))) + (i - 1) * length(pattern) AS before
              FROM (SELECT *, unnest(range(1, len(parts))) AS i
                    FROM (SELECT page_id, rule_name, pattern, string_split(html, pattern) AS parts
                          FROM pages, (VALUES ('script-tag', '<script>'), ('root-link', 'href="/'))
                               AS r(rule_name, pattern))))""",
    # each step looks for the next occurrence one character after the last one, so they may overlap
    "signature_rule_table": """
        WITH RECURSIVE words AS (SELECT string_split(text, ' ') AS w FROM benchmark),
        rules AS (
          SELECT DISTINCT p, 'Low' AS severity FROM (SELECT unnest(w) AS p FROM words) WHERE length(p) >= 6
          UNION
          SELECT DISTINCT w[i] || ' ' || w[i + 1], 'High' FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words)
        ),
        found AS (
          SELECT page_id, p, severity, html AS rest, 0::BIGINT AS before, instr(html, p) AS spot FROM pages JOIN rules ON contains(html, p)
          UNION ALL
          SELECT page_id, p, severity, substr(rest, spot + 1), before + strlen(left(rest, spot)), instr(substr(rest, spot + 1), p) FROM found WHERE spot > 0
        )
        SELECT page_id, p AS rule_name, severity, (before + strlen(left(rest, spot - 1)) + 1)::INTEGER AS match_pos,
               (before + strlen(left(rest, spot - 1)) + strlen(p))::INTEGER AS match_end
        FROM found WHERE spot > 0""",
    "syn_counts": _with("SELECT * FROM syn_counts", "syn_counts"),
    "syn_counts_sliding": _with("""SELECT src_ip, w AS window_start_ms, count(*) AS n_syn
        FROM (SELECT src_ip, timestamp_ms,
                     unnest(range(timestamp_ms - timestamp_ms % 1000 - 4000,
                                  timestamp_ms - timestamp_ms % 1000 + 1, 1000)) AS w FROM syns)
        GROUP BY ALL""", "syns"),
    "syn_counts_reset": _reset("SELECT src_ip, window_start_ms, count(*) AS n_syn FROM placed GROUP BY ALL"),
    "syn_flood_reset_alerts": _reset("SELECT * FROM (" + _anomaly(
        "syn-flood-anomaly", "Critical", "' sent an estimated 50+ SYNs within 5s window'", 2,
        "(SELECT *, row_number() OVER (PARTITION BY src_ip, window_start_ms ORDER BY timestamp_ms, packet_id) AS n FROM placed) WHERE n = 50") + ")"),
    "syn_flood_alerts": _with(_ALERTS + "flood", "flood"),
    "port_distinct": _with(f"""SELECT src_ip, {WIN} AS window_start_ms, count(DISTINCT dst_port) AS n_ports
        FROM packets GROUP BY ALL""", "packets"),
    "port_scan_alerts": _with(_ALERTS + "scan", "scan"),
    "sequence_alerts": _with(_ALERTS + "seq", "seq"),
    "sequence_nstep": _with(_ALERTS + "seq", "seq"),
    "sequence_rule_set": _with(_ALERTS + "seq" + "".join(f"""
        UNION ALL
        SELECT timestamp_ms, '{rule}', '{severity}', {_ip('src_ip')}, {_ip('dst_ip')},
               'CEP rule ''{rule}'' completed: 2 steps matched within {limit}', 'Cep', packet_id, 4, 0, 0 FROM {matches}"""
        for rule, severity, limit, matches in (("exploit-repeated", "High", "8s", "repeats"), ("probe-then-high-port", "Medium", "60s", "high_ports"))),
        "seq", "repeats", "high_ports"),
    "sequence_pairs_all": _with(f"""SELECT e.src_ip, e.timestamp_ms, e.packet_id, count(*) AS n_pairs
        FROM packets e JOIN (SELECT * FROM packets WHERE {SYN}) p
          ON p.src_ip = e.src_ip AND e.timestamp_ms BETWEEN p.timestamp_ms AND p.timestamp_ms + 5000
             AND p.packet_id <> e.packet_id
        WHERE contains(e.payload, 'passwd') GROUP BY ALL""", "packets"),
    "sequence_conversations": "SELECT conv_id, turn, first_time AS started FROM (" + _brackets("""
        SELECT conv_id, turn, turn AS tie, 0 AS o, -1 AS x FROM conversations WHERE role = 'assistant'
        UNION ALL
        SELECT conv_id, turn, turn AS tie, 1 AS o, 1 AS x FROM conversations WHERE role = 'user'""",
        "conv_id", "turn", 2) + ")",
    # user, assistant, user: a user turn is open from the next assistant turn on and closes as brackets do
    "sequence_three_step": """SELECT conv_id, turn, started FROM (
        SELECT *, last_value(CASE WHEN x = 1 THEN own END IGNORE NULLS)
                    OVER (PARTITION BY conv_id, CASE WHEN x = 1 THEN d ELSE pd END ORDER BY turn, tie) AS started
        FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY conv_id ORDER BY turn, tie), 0) AS pd
              FROM (SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn, tie)) AS d
                    FROM (SELECT *, sum(x) OVER (PARTITION BY conv_id ORDER BY turn, tie) AS s FROM (
                      SELECT u.conv_id, min(a.turn) AS turn, u.turn AS tie, 1 AS x, u.turn AS own
                      FROM conversations u JOIN conversations a
                        ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
                      WHERE u.role = 'user' GROUP BY u.conv_id, u.turn
                      UNION ALL
                      SELECT conv_id, turn, turn AS tie, -1 AS x, NULL AS own FROM conversations WHERE role = 'user'))))
        WHERE x = 1 OR pd > 0)
        WHERE x = -1 AND turn - started <= 4""",
    "cms_estimate": _with("SELECT src_ip, window_start_ms, n_syn, n_estimate FROM estimates", "estimates"),
    "cms_flood_sources": _with("""SELECT src_ip, window_start_ms, n_estimate FROM estimates
        WHERE n_estimate >= 50""", "estimates"),
    "cms_flood_alerts": _with(_ALERTS + "cms_alerts", "cms_alerts"),
    "cms_merge": _with("SELECT * FROM cells", "cells"),
    "cms_builtin": _with("""SELECT timestamp_ms - timestamp_ms % 86400000 AS day_ms, 65588 AS n_bytes,
        count(*) AS n_syn FROM syns GROUP BY ALL""", "syns"),
    "hll_estimate": _with(_hll("src_ip, window_start_ms", "dh", "dt"), "ports"),
    "hll_estimate_dense": _with(_hll("dst_port", "sh", "st", textbook=True), "ports"),
    "hll_merge": _with(_hll("src_ip", "dh", "dt"), "ports"),
    "hll_scan_alerts": _with(_ALERTS + "bucket_scan", "bucket_scan"),
    # Spark's sketch of this size stores up to about a hundred values as they are,
    # and no source touches that many ports, so its estimates are exact here.
    "port_distinct_hll": _with(f"""SELECT src_ip, {WIN} AS window_start_ms, count(DISTINCT dst_port) AS n_estimate
        FROM packets GROUP BY ALL""", "packets"),
    "hll_builtin_merge": _with("""SELECT src_ip, count(DISTINCT dst_port) AS n_estimate
        FROM packets GROUP BY ALL""", "packets"),
    "alert_ids": _with("""SELECT id, detector, rule_name, timestamp_ms, packet_id, match_pos
        FROM numbered""", "numbered"),
    "latest_alerts": _with(f"{_ALERTS} alerts ORDER BY {ARRIVAL_DESC} LIMIT 200", "alerts"),
    "alert_retention": _with(f"{_ALERTS} alerts ORDER BY {ARRIVAL_DESC} LIMIT 5000", "alerts"),
    "alert_retention_incremental": _with(f"{_ALERTS} alerts ORDER BY {ARRIVAL_DESC} LIMIT 1000", "alerts"),
    "triage_page": _with(
        f"{_ALERTS} alerts WHERE severity = 'Critical' ORDER BY {ARRIVAL_DESC} LIMIT 500", "alerts"),
    "dedup_alerts": _with(_ALERTS + "alerts", "alerts"),
    "unseen_alerts": _with(_ALERTS + "alerts WHERE timestamp_ms >= 1705363200000", "alerts"),
    "alert_timeline": _with("""SELECT detector, rule_name, severity, packet_id, match_pos, timestamp_ms,
        round(1 - (now_ms - timestamp_ms) / 600000.0::DOUBLE, 6) AS position,
        CASE severity WHEN 'Critical' THEN 14 WHEN 'High' THEN 40 WHEN 'Medium' THEN 66 ELSE 92 END AS lane
        FROM alerts, (SELECT max(timestamp_ms) AS now_ms FROM alerts)
        WHERE now_ms - timestamp_ms <= 600000""", "alerts"),
    "severity_distribution": _with("""SELECT s.severity, severity_rank, count(a.severity) AS n_alerts
        FROM (VALUES ('Critical', 1), ('High', 2), ('Medium', 3), ('Low', 4)) AS s(severity, severity_rank)
        LEFT JOIN alerts a USING (severity) GROUP BY ALL""", "alerts"),
    "detector_distribution": _with(
        "SELECT detector, count(*) AS n_alerts FROM alerts GROUP BY ALL", "alerts"),
    "rule_breakdown": _with(
        "SELECT detector, rule_name, count(*) AS n_alerts FROM alerts GROUP BY ALL", "alerts"),
    "events_per_sec": _with("SELECT run_id, poll_time, round(eps, 6) AS events_per_sec FROM rates", "rates"),
    "dashboard_rate": _with("""SELECT run_id, poll_time,
        CASE WHEN dt > 0 THEN CAST(floor(eps + 0.5) AS BIGINT) END AS shown_rate FROM rates""", "rates"),
    "throughput_summary": _with("""SELECT run_id, round(avg(eps), 6) AS mean_eps,
        round(quantile_cont(eps, 0.5), 6) AS p50_eps, round(quantile_cont(eps, 0.99), 6) AS p99_eps,
        round(max(eps), 6) AS max_eps, arg_max(events_dropped, poll_time) AS total_dropped
        FROM rates GROUP BY run_id""", "rates"),
    "throughput_describe": _with("""SELECT run_id, count(eps) AS n, round(avg(eps), 6) AS mean,
        round(stddev_samp(eps), 6) AS std, round(min(eps), 6) AS min,
        round(quantile_cont(eps, 0.25), 6) AS p25, round(quantile_cont(eps, 0.5), 6) AS p50,
        round(quantile_cont(eps, 0.75), 6) AS p75, round(max(eps), 6) AS max
        FROM rates GROUP BY run_id""", "rates"),
    "stall_check": _with("""SELECT run_id, poll_time, events_processed, coalesce(de <= 0, false) AS stalled
        FROM growth""", "growth"),
    "drop_growth": _with("""SELECT run_id, poll_time, dd AS dropped_growth, de AS processed_growth,
        CASE WHEN de > 0 THEN round(dd / de, 6) END AS drop_ratio FROM growth""", "growth"),
    "engine_stats": _with("""SELECT (SELECT count(*) FROM packets) AS events_processed,
        CAST(0 AS BIGINT) AS events_dropped, (SELECT count(*) FROM alerts) AS alerts_fired,
        CAST(0 AS BIGINT) AS queue_backpressure_events""", "packets", "alerts"),
    "stream_syn_counts": _with("SELECT * FROM syn_counts", "syn_counts"),
    "stream_syn_flood": _with("SELECT * FROM syn_counts WHERE n_syn >= 50", "syn_counts"),
    "stream_flood_alerts": _with(_ALERTS + "flood", "flood"),
    "stream_scan_alerts": _with(_ALERTS + "scan", "scan"),
    "stream_all_alerts": _with(_ALERTS + "alerts", "alerts"),
    "stream_port_scan": _with(f"""SELECT src_ip, {WIN} AS window_start_ms, count(DISTINCT dst_port) AS n_ports
        FROM packets GROUP BY ALL HAVING count(DISTINCT dst_port) >= 25""", "packets"),
    "stream_signature": _with(_ALERTS + "sig", "sig"),
    "stream_sequence": _with(_ALERTS + "seq", "seq"),
    "stream_capture": _with(_ALERTS + "sig", "sig"),
    "stream_flood_at_crossing": _with(_ALERTS + "flood", "flood"),
    "stream_cms_flood_sources": _with("""SELECT src_ip, window_start_ms, n_estimate FROM estimates
        WHERE n_estimate >= 50""", "estimates"),
    "stream_alert_ids": _with("""SELECT id, detector, rule_name, timestamp_ms, packet_id, match_pos
        FROM numbered WHERE detector = 'Signature'""", "numbered"),
    "stream_signature_rules": _with(_ALERTS + "sig", "sig"),
    "stream_decode": _with("""SELECT reason, count(*) AS n, CASE WHEN reason = 'decoded' THEN sum(packet_id)::BIGINT END AS packet_ids,
        CASE WHEN reason = 'decoded' THEN sum(length(payload))::BIGINT END AS payload_bytes
        FROM (SELECT *, CASE WHEN packet_id % 97 = 0 OR packet_id % 101 = 0 THEN 'unreadable'
                             WHEN packet_id % 103 = 0 THEN 'missing timestamp_ms' ELSE 'decoded' END AS reason FROM packets)
        GROUP BY reason""", "packets"),
    "stream_stats": _with("""SELECT (SELECT count(*) FROM packets) AS events_processed,
        CAST(0 AS BIGINT) AS events_dropped, (SELECT count(*) FROM sig) AS alerts_fired""", "packets", "sig"),
}
