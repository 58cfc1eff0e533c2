"""The recipes of ``checks/inputs.py`` in SQL, as named common table expressions."""

from __future__ import annotations

KIND = "(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END)::BIGINT"
SOURCE = "'10.0.' || (user_id // 256) || '.' || (user_id % 256)"
ISO = "'%Y-%m-%dT%H:%M:%S.%f'"

CTES = {
    # The alerts that the lines hold; noise lines hold none.
    "alerts": f"""
        SELECT event_id AS pos, 'log' || (event_id % 3) AS file,
          CASE WHEN event_id % 2 = 0 THEN strftime(ts, {ISO}) || '-06:00' ELSE strftime(ts, '%m/%d-%H:%M:%S.%f') END AS "timestamp",
          '1:' || (1000000 + {KIND}) || ':1' AS signature_id, event_type AS message,
          CASE WHEN event_id % 7 = 0 THEN 'ICMP' ELSE 'TCP' END AS protocol, {SOURCE} AS source_ip,
          CASE WHEN event_id % 7 = 0 THEN '0' ELSE (1024 + event_id % 60000)::VARCHAR END AS source_port,
          '192.168.1.44' AS dest_ip,
          CASE WHEN event_id % 7 = 0 THEN '0' ELSE (CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3306 ELSE 443 END)::VARCHAR END AS dest_port
        FROM events WHERE event_id % 10 <> 9""",
    "lines": f"""
        SELECT event_id AS pos, 'log' || (event_id % 3) AS file,
          CASE WHEN event_id % 10 = 9 THEN 'noise ' || event_id
          WHEN event_id % 2 = 0 THEN strftime(ts, {ISO}) || '-06:00 kali snort: [1:' || (1000000 + {KIND}) || ':1] "' || event_type
            || '" {{' || CASE WHEN event_id % 7 = 0 THEN 'ICMP' ELSE 'TCP' END || '}} ' || {SOURCE}
            || CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' || (1024 + event_id % 60000) END || ' -> 192.168.1.44'
            || CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' || CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3306 ELSE 443 END END
          ELSE strftime(ts, '%m/%d-%H:%M:%S.%f') || ' [**] [1:' || (1000000 + {KIND}) || ':1] "' || event_type || '" '
            || CASE WHEN event_id % 4 = 1 THEN '[**] ' ELSE '' END
            || CASE WHEN event_id % 3 = 0 THEN '[Classification: x y] [Priority: 2] ' ELSE '' END
            || '{{' || CASE WHEN event_id % 7 = 0 THEN 'ICMP' ELSE 'TCP' END || '}} ' || {SOURCE}
            || CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' || (1024 + event_id % 60000) END || ' -> 192.168.1.44'
            || CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' || CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3306 ELSE 443 END END
          END AS value
        FROM events""",
    "kept_alerts": """
        SELECT * FROM alerts WHERE NOT (signature_id = '1:1000002:1' OR (signature_id = '1:1000004:1' AND source_ip = '10.0.0.7')
          OR source_ip = '10.0.0.9' OR (signature_id = '1:1000001:1' AND dest_ip = '192.168.1.45'))""",
    # Text is null where the payload bytes are no UTF-8; raw_text is what the bytes hold after the first.
    "packets": f"""
        SELECT event_id AS packet_id, ts, CASE WHEN event_id % 5 <= 2 THEN 'tcp' WHEN event_id % 5 = 3 THEN 'udp' ELSE 'icmp' END AS protocol,
          CASE WHEN user_id < 60 THEN '192.168.1.' || user_id ELSE {SOURCE} END AS src_ip, user_id,
          CASE WHEN event_id % 9 = 8 THEN '203.0.113.7' ELSE '192.168.1.44' END AS dst_ip,
          CASE WHEN event_id % 5 <> 4 THEN CASE event_id % 6 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3306 WHEN 3 THEN 443 WHEN 4 THEN 514 ELSE 53 END END AS dst_port,
          CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'GET ' WHEN event_id % 17 = 0 THEN NULL ELSE text END AS text,
          CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'GET ' ELSE text END AS raw_text,
          CASE WHEN event_id % 5 <> 4 THEN CASE event_id % 8 WHEN 0 THEN 'F' WHEN 1 THEN 'S' ELSE 'PA' END END AS tcp_flags,
          event_id % 3 <> 0 AS to_server, event_id % 4 <> 0 AS established
        FROM events LEFT JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)""",
    "outside": """
        SELECT * FROM packets WHERE (user_id >= 60 OR user_id = 44)""",
    "inspected": r"""
        SELECT *, text AS message FROM outside
        WHERE protocol IN ('tcp', 'udp') AND dst_port NOT IN (22, 514) AND text IS NOT NULL AND length(text) >= 5
          AND regexp_full_match(text, '[\x20-\x7e\t\n\r\x0b\x0c]+')""",
    "matches": r"""
        SELECT packet_id, ts, src_ip, sid::BIGINT AS sid, rev, msg, df_count, df_seconds FROM packets JOIN (VALUES
          (1000002, 1, 'Word on port 22', 5, 259200), (1000001, 1, 'FIN only', NULL, NULL), (1000004, 1, 'Ping', 2, 43200),
          (1000005, 2, 'Two words', NULL, NULL), (1000006, 1, 'Line end', NULL, NULL)) r(sid, rev, msg, df_count, df_seconds)
        ON dst_ip = '192.168.1.44' AND CASE r.sid
          WHEN 1000002 THEN protocol = 'tcp' AND dst_port = 22 AND to_server AND established AND contains(lower(raw_text), ' the ')
          WHEN 1000001 THEN protocol = 'tcp' AND tcp_flags = 'F'
          WHEN 1000004 THEN protocol = 'icmp'
          WHEN 1000005 THEN protocol = 'udp' AND dst_port = 3306 AND contains(raw_text, ' the ') AND contains(raw_text, ' of ')
          ELSE protocol = 'tcp' AND dst_port = 80 AND contains(raw_text, '.' || chr(10)) END""",
    "detected": """
        SELECT * FROM matches m WHERE df_count IS NULL OR (SELECT count(*) FROM matches n
          WHERE n.sid = m.sid AND n.src_ip = m.src_ip AND n.ts <= m.ts AND n.ts > m.ts - to_seconds(m.df_seconds)) >= df_count""",
    "page_messages": "SELECT page_id, html AS message, page_id % 1024 AS dest_port FROM pages",
    "page_features": r"""
        SELECT page_id, message, dest_port, length(message) AS message_length,
          len(regexp_extract_all(message, '[\$\{\}\(\)''\/]')) AS special_char_count,
          len(regexp_extract_all(lower(message), 'select|union|script|jndi|ldap|payload|attack|exploit|scan')) AS keyword_count
        FROM page_messages""",
    "labelled": "SELECT doc_id AS row_id, text AS message, doc_id % 1024 AS dest_port, toxic AS label FROM documents JOIN labels USING (doc_id)",
    "port_texts": """
        SELECT event_id, CASE event_id % 16
          WHEN 0 THEN '' || event_id WHEN 1 THEN event_id || '.7' WHEN 2 THEN '0x' || event_id WHEN 3 THEN '-'
          WHEN 4 THEN ' ' || event_id || ' ' WHEN 5 THEN event_id || 'e3' WHEN 6 THEN '' WHEN 7 THEN NULL
          WHEN 8 THEN event_id || 'd' WHEN 9 THEN '+' || event_id WHEN 10 THEN '.' || event_id WHEN 11 THEN '-' || event_id
          WHEN 12 THEN 'inf' WHEN 13 THEN '9' || event_id || 'e300' WHEN 14 THEN event_id || '.' ELSE '1e400' END AS port_text
        FROM events""",
    "raw_labels": """
        SELECT event_id, event_type, CASE event_id % 10
          WHEN 0 THEN 'BENIGN' WHEN 1 THEN ' Normal ' WHEN 2 THEN '0' WHEN 3 THEN 'DDoS' WHEN 4 THEN '1' WHEN 5 THEN '1.0'
          WHEN 6 THEN '10' WHEN 7 THEN NULL WHEN 8 THEN 'Bot-' || event_type ELSE 'benign traffic' END AS raw_label
        FROM events""",
    "mined_messages": """
        SELECT event_id, event_type, CASE event_id % 6
          WHEN 0 THEN event_type || ' payload=p' || event_id || ' rest' WHEN 1 THEN event_type || ' payload=a' || event_id || 'payload=b c'
          WHEN 2 THEN 'Generic ' || event_type WHEN 3 THEN 'unknown ' || event_type WHEN 4 THEN 'Unknown ' || event_type
          ELSE event_type END AS message
        FROM events""",
    "hinted": """
        SELECT *, CASE event_id % 6 WHEN 0 THEN 'p' || event_id WHEN 1 THEN 'a' || event_id ELSE 'unknown' END AS hint FROM mined_messages""",
    "packet_rules": """
        SELECT event_id, event_type, 'alert tcp any any -> $HOME_NET 80 (msg:"' || event_type || '"; content:"' || event_id || '"' AS head,
          event_id % 8 AS shape FROM events""",
    "clean_packet_rules": """
        SELECT event_id, shape, CASE shape WHEN 0 THEN head || '; sid:5; rev:1;)' WHEN 1 THEN head || '; sid: 77; rev:1;)'
          WHEN 2 THEN head || '; sid:5;  rev:1;)' WHEN 3 THEN head || ';)' WHEN 6 THEN head || '; rev:1;)'
          WHEN 7 THEN head || '; content:"database(), user()"; sid:5; rev:1;) ``` It looks for a call (see above;)' END AS rule,
          CASE shape WHEN 4 THEN 'unbalanced quotes' WHEN 5 THEN 'no rule' END AS reject_reason
        FROM packet_rules""",
    "suggestion_heads": """
        SELECT event_id, event_id % 7 AS shape, 'tcp any any -> $HOME_NET 80 (msg:"' || event_type || '"; content:"' || event_id || '"' AS head FROM events""",
    "clean_suggestions": """
        SELECT event_id, CASE shape WHEN 0 THEN 'alert ' || head || '; sid:5; rev:1;)' WHEN 1 THEN 'alert ' || head || '; sid:5; rev:1;)'
          WHEN 2 THEN 'drop ' || head || '; sid:5; rev:1;)' WHEN 3 THEN 'alert ' || head || '; content:"f();x"; sid:5; rev:1;)'
          WHEN 6 THEN 'reject ' || head || '; sid:5; rev:1)' END AS rule
        FROM suggestion_heads""",
}


def sql(select: str, *names: str) -> str:
    """A statement over the named recipes, in the order given."""
    if not names:
        return select
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + select
