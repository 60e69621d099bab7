"""The named queries in plain SQL over the same tables, written without the operators."""

from __future__ import annotations

from .catalog import SERVICES, VENDORS

PACKETS = """p as (
  select event_id as pkt_id, ts, 167772160 + user_id as src_ip, 3232235520 + k as dst_ip,
    cast(10001 + user_id % 7 as int) as src_port,
    cast(case k % 5 when 0 then 80 when 1 then 443 when 2 then 22 when 3 then 53 else 8080 end as int) as dst_port,
    cast(case when k % 5 = 3 then 17 else 6 end as int) as proto,
    cast(case event_type when 'signup' then 2 when 'error' then 4 when 'purchase' then 17 when 'view' then 16 else 24 end as int) as tcp_flags,
    cast(round(value * 100) as bigint) as pkt_len
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""

BIDIR = (
    PACKETS
    + """, b as (
  select pkt_id, ts, proto, tcp_flags, pkt_len,
    case when pkt_id % 2 = 1 then dst_ip else src_ip end as src_ip, case when pkt_id % 2 = 1 then src_ip else dst_ip end as dst_ip,
    case when pkt_id % 2 = 1 then dst_port else src_port end as src_port, case when pkt_id % 2 = 1 then src_port else dst_port end as dst_port
  from p), s as (
  select *, case when f then src_ip else dst_ip end as a_ip, case when f then dst_ip else src_ip end as b_ip,
    case when f then src_port else dst_port end as a_port, case when f then dst_port else src_port end as b_port
  from (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as f from b)), v as (
  select *, cast(coalesce(sum(case when proto = 6 and tcp_flags & 5 <> 0 then 1 else 0 end)
    over (partition by a_ip, b_ip, a_port, b_port order by ts, pkt_id rows between unbounded preceding and 1 preceding), 0) as bigint) as version
  from s), o as (
  select *, src_ip = s_ip and src_port = s_port as same from (
    select *, first_value(src_ip) over w as s_ip, first_value(src_port) over w as s_port, row_number() over w as nth
    from v window w as (partition by a_ip, b_ip, a_port, b_port, version order by ts, pkt_id)))"""
)

FLOW = "src_ip, dst_ip, src_port, dst_port"
GENERATION = f"cast(coalesce(sum(case when proto = 6 and tcp_flags & 5 <> 0 then 1 else 0 end) over (partition by {{}} order by ts, pkt_id rows between unbounded preceding and 1 preceding), 0) as bigint)"


def of(select: str, base: str = PACKETS) -> str:
    return f"with {base} {select}"


def counted(key: str, name: str, where: str = "true") -> str:
    return of(f"select {key} as {name}, count(*) as packets, cast(sum(pkt_len) as bigint) as bytes from p where {where} group by 1")


def values(rows: list[tuple]) -> str:
    def said(x: object) -> str:
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


def subnet(prefix: int) -> str:
    return of(f"select src_ip >> {32 - prefix} as subnet, count(*) as packets, count(*) * 64 as charged from p group by 1")


def context(ip: str) -> str:
    def by(column: str, name: str, n: int) -> str:
        return ", ".join(f"count(*) filter ({column} = {k}) as {name}_{k}, max(ts) filter ({column} = {k}) as {name}_{k}_last" for k in range(n))

    return of(
        f"select {ip} as ip, count(distinct os_id) as os_count, count(distinct service_id) as service_count, {by('os_id', 'os', 4)}, {by('service_id', 'service', 5)} from x group by 1",
        f"{PACKETS}, {SYSTEMS}, x as (select p.*, os_id, case dst_port when 80 then 0 when 443 then 1 when 22 then 2 when 53 then 3 when 8080 then 4 end as service_id from p left join (select pkt_id, sig_id as os_id from sy) using (pkt_id))",
    )


#: Packets whose made-up header fits a signature of an operating system.
SYSTEMS = """sy as (select pkt_id, sig_id from (select pkt_id, cast(case
  when pkt_id % 3 = 0 and pkt_id % 2 = 0 and pkt_id % 70 <= 64 then 0
  when pkt_id % 3 = 1 and pkt_id % 70 <= 128 then 1
  when pkt_id % 3 = 2 and pkt_id % 2 = 1 and pkt_id % 5 = 0 and pkt_id % 70 <= 64 then 2 end as int) as sig_id from p where proto = 6)
  where sig_id is not null)"""

#: What the frames of all sorts say, without their bytes.
FRAMES = """f as (select *, case turn when 3 then 'arp' when 4 then 'ip6' when 6 then 'other' else 'ip4' end as link,
    case turn when 3 then 2054 when 4 then 34525 when 6 then 35020 else 2048 end as eth_type,
    case turn when 1 then 1 + src_ip % 4094 when 2 then 100 end as vlan,
    case when turn in (3, 4, 6) then null when pr = 6 then 'tcp' when pr = 17 then 'udp' when pr = 1 then 'icmp' when pr in (4, 41) then 'ip4ip' when pr = 47 then 'gre' else 'other' end as transport
  from (select *, pkt_id % 8 as turn, case when pkt_id % 8 = 5 then [1, 4, 41, 47, 50][(pkt_id // 8) % 5 + 1] else proto end as pr,
    case when pkt_id % 3 = 0 then 0 else pkt_id * 37 % 1800 end as pl from p))"""

#: Fixed values, written out again so that a wrong table doesn't agree with itself.
KNOWN_PORTS = """
  (6, 20, '@ftp-data'), (6, 21, '@ftp'), (6, 22, '@ssh'), (6, 25, '@smtp'), (17, 53, '@domain'), (6, 80, '@www'),
  (6, 110, '@pop3'), (6, 111, '@sunrpc'), (17, 111, '@sunrpc'), (6, 113, '@auth'), (6, 115, '@sftp'), (6, 119, '@nntp'),
  (17, 123, '@ntp'), (6, 143, '@imap2'), (6, 161, '@snmp'), (17, 161, '@snmp'), (6, 162, '@snmp-trap'), (17, 162, '@snmp-trap'),
  (6, 389, '@ldap'), (6, 443, '@https'), (6, 445, '@microsoft-ds'), (17, 514, '@syslog'), (6, 554, '@rtsp'), (17, 554, '@rtsp'),
  (6, 631, '@ipp'), (6, 990, '@ftps'), (6, 992, '@telnets'), (6, 993, '@imaps'), (6, 995, '@pop3s'), (17, 1194, '@openvpn'),
  (6, 2049, '@nfs'), (17, 2049, '@nfs'), (6, 3306, '@mysql'), (6, 6667, '@irc')"""
LINK_TYPES = """
  (256, 'radio modem'), (386, 'ethernut'), (552, 'SLIP line / encap ppp'), (576, 'sometimes modem'),
  (1280, 'gif tunnel'), (1300, 'PIX, SMC, sometimes wireless'), (1362, 'sometimes DSL (1)'), (1372, 'cable modem'),
  (1400, '(Google/AOL)'), (1408, 'virtualization'), (1415, 'sometimes wireless'), (1420, 'GPRS, T1, FreeS/WAN'),
  (1423, 'sometimes cable'), (1440, 'sometimes DSL (2)'), (1442, 'IPIP tunnel'), (1450, 'vtun'),
  (1452, 'sometimes DSL (3)'), (1454, 'sometimes DSL (4)'), (1456, 'ISDN ppp'), (1458, 'BT DSL (?)'),
  (1460, '3G WAN'), (1462, 'sometimes DSL (5)'), (1470, '(Google 2)'), (1476, 'IPSec/GRE'),
  (1480, 'IPv6/IPIP'), (1492, 'pppoe (DSL)'), (1496, 'vLAN'), (1500, 'ethernet/modem'),
  (1656, 'Ericsson HIS'), (2024, 'wireless/IrDA'), (2048, 'Cyclom X.25 WAN'), (2250, 'AiroNet wireless'),
  (3924, 'loopback'), (4056, 'token ring (1)'), (4096, 'Sangoma X.25 WAN'), (4352, 'FDDI'),
  (4500, 'token ring (2)'), (9180, 'FORE ATM'), (16384, 'sometimes loopback (1)'), (16436, 'sometimes loopback (2)'),
  (18000, 'token ring x4')"""

PORTS = f"kp as (select proto, port, first_value(name) over (partition by port order by nth) as service from (select *, row_number() over () as nth from (values {KNOWN_PORTS}) t(proto, port, name)))"
LOCALITY = "((src_ip >> 24) & 255) + ((src_ip >> 16) & 255) + ((src_ip >> 8) & 255) + (src_ip & 255)"
MATCHED = """case when contains(text, 'license') then 1 when regexp_matches(text, '[Ll]icensed under the [A-Z]') then 2
  when contains(text, 'thth') then 3 when regexp_matches(text, '[0-9]{3}-[0-9]{4}') then 4 end"""
NAT = f"""n as (select *, row_number() over (order by first_ts, first_pkt) as nth from (
  select {FLOW}, min(ts) as first_ts, arg_min(pkt_id, (ts, pkt_id)) as first_pkt from p where proto = 6 group by all)),
  t as (select {FLOW}, case when nth <= 64512 then cast(1023 + nth as int) end as new_port from n)"""
SEGMENTS = """g as (select pkt_id, src_ip, cast(row_number() over (partition by src_ip order by pkt_id * 7919 % 64 + pkt_id, pkt_id) as int) as seq,
  cast(row_number() over (partition by src_ip order by ts, pkt_id) as int) as arrival from p where proto = 6), r as (
  select *, max(arrival) over (partition by src_ip order by seq) as release from g), q as (select *, release > arrival as buffered from r)"""

SQL: dict[str, str] = {
    "src_ip_counter": counted("src_ip", "ip"),
    "dst_ip_counter": counted("dst_ip", "ip"),
    "counter_report": of("select count(distinct dst_ip) as n_keys, count(*) as total from p"),
    "packets_parse": of("select * from p"),
    "ip_print": of("select distinct src_ip, concat_ws('.', src_ip >> 24 & 255, src_ip >> 16 & 255, src_ip >> 8 & 255, src_ip & 255) as printed from p"),
    "sym_flow_key": of("select pkt_id, a_ip, b_ip, a_port, b_port from s", BIDIR),
    "port_key_counter": counted("dst_port", "port"),
    "locality_hash": of(f"select pkt_id, {LOCALITY} + ((dst_ip >> 24) & 255) + ((dst_ip >> 16) & 255) + ((dst_ip >> 8) & 255) + (dst_ip & 255) as h, {LOCALITY} + (src_port >> 8) + (src_port & 255) + (dst_port >> 8) as h_rule from p"),
    "name_keys": "select n_name, sha1(substr(n_name, 1, 7)) as k from nation",
    "header_checksum": of("select pkt_id, 65535 - ((x & 65535) + (x >> 16)) as checksum from (select pkt_id, (t & 65535) + (t >> 16) as x from (select pkt_id, 17664 + (pkt_len & 65535) + pkt_id % 65536 + 16384 + proto + (src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535) as t from p))"),
    **{f"subnet_counter_{k}": subnet(k) for k in (8, 16, 24, 30, 32)},
    "dst_subnet_report": of("select count(distinct dst_ip >> 2) as n_keys, count(*) as total from p"),
    "accounting": of("select src_ip >> 2 as subnet, count(*) * 64 as charged, 'forward' as verdict from p group by 1"),
    "udp_flow_counter": of(f"select {FLOW}, count(*) as packets, cast(sum(pkt_len) as bigint) as bytes from p where proto = 17 group by all"),
    "state_size_counter": of("select dst_ip as ip, count(*) as packets, size as state_bytes from p, (values (32), (1024), (32768)) t(size) group by dst_ip, size"),
    "echo_sink_verdict": of("select 'forward' as verdict, count(*) as packets, 'echo' as app from p union all select 'drop', count(*), 'sink' from p"),
    "ids_protocol_verdict": of("select proto, case when proto = 6 then 'forward' else 'drop' end as verdict, count(*) as packets from p group by all"),
    "flow_created_flag": of(f"select pkt_id, row_number() over (partition by {FLOW} order by ts, pkt_id) = 1 as created from p"),
    "flow_generation": of(f"select pkt_id, version, row_number() over (partition by {FLOW}, version order by ts, pkt_id) = 1 as created from (select *, {GENERATION.format(FLOW)} as version from p)"),
    "dynamic_flow_counter": of(f"select dst_ip, version, count(*) as packets from (select *, {GENERATION.format('dst_ip')} as version from p) group by all"),
    "remove_at_10": of(f"select pkt_id, (nth - 1) // 10 as version, (nth - 1) % 10 + 1 as count from (select *, row_number() over (partition by {FLOW} order by ts, pkt_id) as nth from p where proto = 17)"),
    "byte_quota": of("select pkt_id, prior, prior < 5000 as admitted from (select pkt_id, cast(coalesce(sum(pkt_len) over (partition by src_ip order by ts, pkt_id rows between unbounded preceding and 1 preceding), 0) as bigint) as prior from p)"),
    "inc_and_get_running": of("select pkt_id, row_number() over (partition by dst_ip order by ts, pkt_id) as count from p"),
    "tcp_flow": of(
        f"""select {FLOW}, o & 2 <> 0 as "set",
      case when o & 18 = 18 then src_ip when o & 2 <> 0 then dst_ip end as svr_ip,
      case when o & 18 = 18 then src_port when o & 2 <> 0 then dst_port end as svr_port,
      case when o & 2 <> 0 then n else 0 end as pkt_cnt,
      case when o & 18 = 18 then bytes else 0 end as s2c_bytes,
      case when o & 18 = 2 then bytes else 0 end as c2s_bytes, start_time, end_time
    from (select {FLOW}, count(*) as n, cast(sum(pkt_len) as bigint) as bytes, min(ts) as start_time, max(ts) as end_time, arg_min(tcp_flags, (ts, pkt_id)) as o from p where proto = 6 group by all)"""
    ),
    "connection": of(
        """select a_ip, b_ip, a_port, b_port, version, min(s_ip) as s_ip, min(s_port) as s_port,
      count(*) filter (same) as s_pkts, count(*) filter (not same) as d_pkts,
      cast(coalesce(sum(pkt_len) filter (same), 0) as bigint) as s_bytes, cast(coalesce(sum(pkt_len) filter (not same), 0) as bigint) as d_bytes,
      coalesce(bit_or(case when proto = 6 then tcp_flags else 0 end) filter (same), 0) as s_flags,
      coalesce(bit_or(case when proto = 6 then tcp_flags else 0 end) filter (not same), 0) as d_flags,
      min(ts) as start_time, max(ts) as last_pkt_time from o group by a_ip, b_ip, a_port, b_port, version""",
        BIDIR,
    ),
    "connection_reversed": of(
        """select a_ip, b_ip, a_port, b_port, version, r as reversed,
      case when r then d else c end as s_pkts, case when r then c else d end as d_pkts,
      case when r then y else x end as s_bytes, case when r then x else y end as d_bytes,
      case when r then h else g end as s_flags, case when r then g else h end as d_flags
    from (select a_ip, b_ip, a_port, b_port, version, count(*) filter (same) as c, count(*) filter (not same) as d,
      cast(coalesce(sum(pkt_len) filter (same), 0) as bigint) as x, cast(coalesce(sum(pkt_len) filter (not same), 0) as bigint) as y,
      coalesce(bit_or(case when proto = 6 then tcp_flags else 0 end) filter (same), 0) as g,
      coalesce(bit_or(case when proto = 6 then tcp_flags else 0 end) filter (not same), 0) as h,
      coalesce(arg_max(not same, (ts, pkt_id)) filter (proto = 6 and tcp_flags & 18 = 18), false) as r
      from o group by a_ip, b_ip, a_port, b_port, version)""",
        BIDIR,
    ),
    "connection_roles": of("select pkt_id, case when nth = 1 then null when same then 'client' else 'server' end as role from o", BIDIR),
    "proto_stats": of(
        """select p1.*, p2.*, p3.* from (select count(*) as got_packets, count(*) as eth_recv, count(*) filter (link = 'arp') as arp_recv, count(*) filter (link = 'other') as otherl_recv, count(vlan) as vlan_recv,
        count(*) filter (link = 'ip4') as ip4_recv, count(*) filter (link = 'ip6') as ip6_recv, count(*) filter (transport = 'ip4ip') as ip4ip_recv, cast(0 as bigint) as ip6ip_recv, count(*) filter (transport = 'gre') as gre_recv,
        count(*) filter (transport = 'tcp') as tcp_recv, count(*) filter (transport = 'udp') as udp_recv, count(*) filter (transport = 'icmp') as icmp_recv, count(*) filter (transport = 'other') as othert_recv,
        count(distinct src_ip) filter (link = 'ip4') as assets from f) p1,
      (select count(distinct (src_ip, sig_id)) as tcp_os_assets, cast(0 as bigint) as udp_os_assets, cast(0 as bigint) as icmp_os_assets, cast(0 as bigint) as dhcp_os_assets from sy join p using (pkt_id)) p2,
      (select count(distinct (dst_ip, dst_port)) filter (p.proto = 6) as tcp_services, count(distinct src_ip) filter (p.proto = 6) as tcp_clients,
        count(distinct (dst_ip, dst_port)) filter (p.proto = 17) as udp_services, count(distinct src_ip) filter (p.proto = 17) as udp_clients
        from p join kp on p.proto = kp.proto and p.dst_port = kp.port) p3""",
        f"{PACKETS}, {FRAMES}, {SYSTEMS}, {PORTS}",
    ),
    "asset_table": of("select src_ip as ip, date_trunc('second', min(ts)) as first_seen, date_trunc('second', max(ts)) as last_seen, count(*) - 1 as attempts, cast(coalesce(arg_max(coalesce(vlan, 0), (ts, pkt_id)), 0) as int) as vlan from f where link = 'ip4' group by 1", f"{PACKETS}, {FRAMES}"),
    "asset_os_list": of("select src_ip as ip, sig_id, count(*) - 1 as attempts, min(ts) as first_seen, max(ts) as last_seen from p join sy using (pkt_id) group by all", f"{PACKETS}, {SYSTEMS}"),
    "asset_service_list": of("select dst_ip as ip, service, dst_port as port, count(*) - 1 as attempts, min(ts) as first_seen, max(ts) as last_seen from p left join kp on p.proto = kp.proto and p.dst_port = kp.port group by all", f"{PACKETS}, {PORTS}"),
    "asset_context_src": context("src_ip"),
    "asset_context_dst": context("dst_ip"),
    "known_port_join": of("select pkt_id, service from p left join kp on p.proto = kp.proto and p.dst_port = kp.port", f"{PACKETS}, {PORTS}"),
    "ids_string_match": "select doc_id, case when contains(text, 'license') then 1 else 3 end as matched from documents where contains(text, 'license') or contains(text, 'thth')",
    "ids_regex_match": "select doc_id, case when regexp_matches(text, '[Ll]icensed under the [A-Z]') then 2 else 4 end as matched from documents where regexp_matches(text, '[Ll]icensed under the [A-Z]') or regexp_matches(text, '[0-9]{3}-[0-9]{4}')",
    "attack_count": of(
        """select src_ip, cast(sum(n) as bigint) as attack_count, count(*) as n_flows,
      string_agg(dst_ip || ':' || src_port || ':' || dst_port, ',' order by dst_ip, src_port, dst_port) filter (k <= 9) as flows
    from (select *, row_number() over (partition by src_ip order by dst_ip, src_port, dst_port) as k from (
      select src_ip, dst_ip, src_port, dst_port, count(*) as n from p join d on p.pkt_id = d.doc_id where proto = 6 group by all)) group by src_ip""",
        f"{PACKETS}, d as (select doc_id from documents where {MATCHED} is not null)",
    ),
    "ids_pass_fail": of("select count(*) filter (proto = 6) as pass_cnt, count(*) filter (proto <> 6) as fail_cnt from p"),
    "service_fingerprint": f"""with d as (select doc_id, substr(text, 1, 600) as t from documents where length(text) >= 10)
      select doc_id, case when regexp_matches(t, '{SERVICES[0][5]}') then 0 else 1 end as sig_id, case when regexp_matches(t, '{SERVICES[0][5]}') then 'mail' else 'text' end as service,
        case when regexp_matches(t, '{SERVICES[0][5]}') then 'mailer ' || regexp_extract(t, '{SERVICES[0][5]}', 1) else 'prose (en)' end as title
      from d where regexp_matches(t, '{SERVICES[0][5]}') or regexp_matches(t, '{SERVICES[1][5]}')""",
    "os_fingerprint": of("select * from sy", f"{PACKETS}, {SYSTEMS}"),
    "mac_vendor_lpm": of("select pkt_id, (select arg_max(vendor, bits) from v where starts_with(printf('%08X', src_ip) || '0000', prefix)) as vendor from p", f"{PACKETS}, v as (select * from (values {values(VENDORS)}) t(prefix, bits, vendor))"),
    "whitelist_semi": of("select pkt_id, src_ip from p where src_ip - 167772160 in (select s_suppkey from supplier)"),
    "whitelist_anti": of("select pkt_id, src_ip from p where src_ip - 167772160 not in (select s_suppkey from supplier)"),
    "whitelist_learned": of("select pkt_id, row_number() over (partition by src_ip order by ts, pkt_id) > 1 as known from p"),
    "nat_table": of(f"select {FLOW}, new_port from t", f"{PACKETS}, {NAT}"),
    "nat_rewrite": of(
        """select p.pkt_id, case when t.new_port is null then p.src_ip else 167772161 end as src_ip, p.dst_ip,
      coalesce(t.new_port, p.src_port) as src_port, p.dst_port from p join t using (src_ip, dst_ip, src_port, dst_port) where proto = 6
    union all select -p.pkt_id - 1, p.dst_ip, p.src_ip, p.dst_port, p.src_port from p join t using (src_ip, dst_ip, src_port, dst_port) where proto = 6 and pkt_id % 2 = 1 and t.new_port is not null""",
        f"{PACKETS}, {NAT}",
    ),
    "reasm_release": of("select * from q", f"{PACKETS}, {SEGMENTS}"),
    "reasm_buffer_occupancy": of(
        """select src_ip, count(*) filter (d = 1) as n_buffered, max(held) as peak, max(held) > 32 as overflow from (
      select src_ip, d, cast(sum(d) over (partition by src_ip order by "at", d rows unbounded preceding) as bigint) as held from (
        select src_ip, arrival as "at", 1 as d from q where buffered union all select src_ip, release, -1 from q where buffered)) group by src_ip""",
        f"{PACKETS}, {SEGMENTS}",
    ),
    "placement_local": of("select -1 as worker, count(*) as packets from p"),
    "placement_static": of("select 3 as worker, count(*) as packets from p"),
    "placement_hashing": of("select cast((src_ip + dst_ip + src_port + dst_port) % 16 as int) as worker, count(*) as packets from p group by 1"),
    "placement_balanced": of(f"select cast(({LOCALITY} + ((dst_ip >> 24) & 255) + ((dst_ip >> 16) & 255) + ((dst_ip >> 8) & 255) + (dst_ip & 255)) % 16 as int) as worker, count(*) as packets from p group by 1"),
    "limit_packets": of("select pkt_id, ts from p order by ts, pkt_id limit 96"),
    "top_talkers": of("select src_ip as ip, count(*) as packets, cast(sum(pkt_len) as bigint) as bytes from p group by 1 order by bytes desc, ip limit 10"),
    "synthetic_udp": "select i as pkt_id, 3232235520 + i % 255 as src_ip, 167772160 + i % 255 as dst_ip, cast((1234 + i) % 65536 as int) as src_port, 5678 as dst_port, 17 as proto, cast(60 as bigint) as pkt_len from range(4096) t(i)",
    "flow_generator": """select f as flow_id, cast(n as int) as nth, round(f / 10.0 + (n - 1) * 2.0, 3)::double as ts,
      167772160 + 1 + (f + 1) % 3 * 3 as src_ip, 3232235520 + 1 + (f + 1) % 3 * 3 as dst_ip, 1024 as src_port, 80 as dst_port,
      case when n = 1 then 2 when n = 5 then 17 else 16 end as tcp_flags from range(50) t(f), range(1, 6) u(n)""",
    "random_update": of("select cast(1 as bigint) as residue, count(*) as packets, true as inside, cast(10 as bigint) as tenths from p"),
    "known_ports_table": f"with {PORTS} select * from kp",
    "link_types_table": f"select * from (values {LINK_TYPES}) t(mtu, link)",
    "string_functions": """select p_partkey, substr(s, 2, 3) as mid, substr(s, 1, 1) || substr(s, 4) as deleted, substr(s, 1, 2) || '--' || substr(s, 3) as inserted,
      cast(instr(s, 'a') - 1 as int) as found, cast(case when instr(s, 'a') = 0 then -1 else length(s) - instr(reverse(s), 'a') end as int) as last,
      cast(case when regexp_matches(s, '[xyz ]') then length(regexp_extract(s, '^[^xyz ]*')) else -1 end as int) as any_of,
      substr(repeat(substr(s, 1, 2), 5), 1, 5) as pat, replace(s, ' ', '+') as joined, case when s < 'm' then -1 when s > 'm' then 1 else 0 end as cmp,
      s as trimmed, cast(length(s) + 2 as int) as left_trimmed, printf('%s/%05d', s, p_partkey) as formatted, list_reduce(list_transform(string_split(s, ' '), lambda x: reverse(x)), lambda a, b: a || '-' || b) as each_reversed
      from (select p_partkey, p_name as s from part)""",
    "payload_scan": "select doc_id, cast(case when length(text) >= 10 then least(length(text), 600) end as int) as scanned from documents",
    "packet_jitter": of(
        """select count(*) as n, round(quantile_disc(gap, 0.5), 3) as p50, round(quantile_disc(gap, 0.99), 3) as p99 from (
      select epoch(ts) - lag(epoch(ts)) over (partition by src_ip order by ts, pkt_id) as gap from p) where gap is not null"""
    ),
    "idle_sessions": of(
        """select src_ip, min(ts) as started, count(*) as packets from (
      select *, sum(case when gap is null or gap >= interval 1 hour then 1 else 0 end) over (partition by src_ip order by ts, pkt_id) as nth from (
        select *, ts - lag(ts) over (partition by src_ip order by ts, pkt_id) as gap from p)) group by src_ip, nth"""
    ),
    "throughput_by_hour": of("select cast(floor(epoch(ts) / 3600) as bigint) * 3600 as started, count(*) as packets, cast(sum(pkt_len) * 8 as bigint) as bits from p group by 1"),
    "concurrency_stats": of("select max(active) as most, quantile_cont(active, 0.5) as median from (select ts, count(*) as active from p group by ts)"),
}
QUIRKS = "{0} | case when seq = ack then 2048 else 0 end | case when seq = 0 then 4096 else 0 end | case when tcp_flags & 41 <> 0 then 128 else 0 end | case when ack <> 0 then 32 else 0 end | case when urg <> 0 then 8 else 0 end"
SQL |= {
    "frame_decode": of(
        """select pkt_id, cast(2048 as bigint) as eth_type, src_ip, dst_ip, cast(src_port as bigint) as src_port, cast(dst_port as bigint) as dst_port,
      cast(proto as bigint) as proto, cast(case when proto = 6 then tcp_flags end as bigint) as tcp_flags, cast(64 as bigint) as ttl, cast(1 as bigint) as df,
      l as pkt_len, l - 20 as packet_bytes, l - case when proto = 6 then 40 else 28 end as payload_len, case when proto = 6 then pkt_id end as seq
    from (select *, least(pkt_len, 65535) as l from p)"""
    ),
    "packet_kinds": of(
        """select case when proto <> 6 then 'other' when tcp_flags & 18 = 18 then 'synack' when tcp_flags & 2 <> 0 then 'syn' when tcp_flags & 1 <> 0 then 'fin'
      when tcp_flags & 4 <> 0 then 'rst' when tcp_flags & 16 <> 0 then 'ack' else 'other' end as kind, proto, count(*) as packets from p group by all"""
    ),
    "tcp_quirks": of(f"select pkt_id, cast({QUIRKS.format('0')} as int) as syn, cast({QUIRKS.format('case when tcp_flags & 16 <> 0 then 8192 else 0 end')} as int) as fin from (select pkt_id, tcp_flags, pkt_id % 3 as seq, pkt_id % 4 as ack, pkt_id % 2 as urg from p where proto = 6)"),
    "tcp_fingerprint": of(
        """select pkt_id, case when pkt_id % 2 = 0 then 'S4' else '1000' end || ':64:1:' || case when s < 100 then cast(s as varchar) else '*(' || s || ')' end
      || case pkt_id % 3 when 0 then ':M1460,S,T,N,W7' when 1 then ':M1460' else ':.' end || ':.' as fingerprint
    from (select pkt_id, pkt_id % 120 as s from p where proto = 6)"""
    ),
    "home_net": of("select pkt_id, src_ip, dst_ip from p where src_ip >> 4 = 167772160 >> 4 or dst_ip >> 5 = (3232235520 + 64) >> 5"),
    "enabled_checks": of("select tcp_flags, count(*) as packets from p where tcp_flags & 24 = 24 group by all"),
    "state_lookup": of("select pkt_id, p.dst_ip, seen from p left join (select dst_ip, count(*) as seen from p where proto = 17 group by 1) s on p.dst_ip = s.dst_ip"),
    "stale_counter": of("select pkt_id, (select count(*) from p q where q.dst_ip = p.dst_ip and date_trunc('day', q.ts) < date_trunc('day', p.ts)) as stale from p"),
    "first_match_per_connection": of("select a_ip, b_ip, a_port, b_port, arg_min(pkt_id, (ts, pkt_id)) as pkt_id from s where tcp_flags = 24 group by all", BIDIR),
    "ordered_state": of("select dst_port as port, count(*) as packets from p group by 1"),
    "flow_context": of(f"select {FLOW}, arg_min(pkt_id, (ts, pkt_id)) as init_seq, cast(sum(pkt_len) as bigint) as total_bytes from p where proto = 6 group by all"),
    "forwarded_packets": of("select pkt_id, proto, 'forward' as verdict from p where proto = 6"),
}
SQL |= {
    "frame_dispatch": of(
        """select pkt_id, vlan, cast(eth_type as bigint) as eth_type, link, transport, cast(least(length, 1604) as int) as captured, cast(case when transport in ('tcp', 'udp') then pl end as bigint) as payload_len
      from (select *, case when link <> 'ip4' then 60 else case turn when 1 then 18 when 2 then 22 else 14 end + 20 + case when pr = 6 then 20 else 8 end + pl end as length from f)""",
        f"{PACKETS}, {FRAMES}",
    ),
    "segments_with_payload": of("select pkt_id, cast(pl as bigint) as payload_len from f where transport in ('tcp', 'udp') and pl > 0", f"{PACKETS}, {FRAMES}"),
    "asset_inventory": of(
        """select ip, attempts, oses, services from (select src_ip as ip, count(*) - 1 as attempts from b group by 1)
      left join (select ip, string_agg(sig_id || ':' || n, ',' order by sig_id) as oses from (select src_ip as ip, sig_id, count(*) - 1 as n from b join sy using (pkt_id) group by all) group by ip) using (ip)
      left join (select ip, string_agg(service || ':' || port || ':' || n, ',' order by service, port) as services from (
        select dst_ip as ip, service, dst_port as port, count(*) - 1 as n from b join kp on b.proto = kp.proto and b.dst_port = kp.port group by all) group by ip) using (ip)""",
        f"{BIDIR}, {SYSTEMS}, {PORTS}",
    ),
    "connection_assets": of(
        """select c.*, x.first_seen as client_first_seen, x.attempts as client_attempts, y.first_seen as server_first_seen, y.attempts as server_attempts from (
        select a_ip, b_ip, a_port, b_port, version, case when r then o_ip else s_ip end as client, case when r then s_ip else o_ip end as server from (
          select a_ip, b_ip, a_port, b_port, version, min(s_ip) as s_ip, case when min(s_ip) = a_ip then b_ip else a_ip end as o_ip,
            coalesce(arg_max(not same, (ts, pkt_id)) filter (proto = 6 and tcp_flags & 18 = 18), false) as r from o group by a_ip, b_ip, a_port, b_port, version)) c
      left join seen x on x.ip = client left join seen y on y.ip = server""",
        f"{BIDIR}, seen as (select src_ip as ip, date_trunc('second', min(ts)) as first_seen, count(*) - 1 as attempts from b group by 1)",
    ),
    "round_trip_times": of(
        """select count(*) as n, round(avg(rtt), 3) as average, round(quantile_disc(rtt, 0.5), 3) as p50, round(quantile_disc(rtt, 0.99), 3) as p99 from (
      select epoch(ts) - lag(epoch(ts)) over w as rtt, f <> lag(f) over w as answer from s window w as (partition by a_ip, b_ip, a_port, b_port order by ts, pkt_id)) where answer""",
        BIDIR,
    ),
    "rate_limited": of("select pkt_id, ts, src_ip from p qualify row_number() over (partition by date_trunc('hour', ts) order by ts, pkt_id) <= 5"),
    **{f"dealt_{kind}": of(f"select worker, packets, cast(1 as bigint) as partitions from ({SQL[f'placement_{kind}'].removeprefix(f'with {PACKETS} ')})") for kind in ("hashing", "balanced")},
    "read_os_signatures": """select * from (values
      (0, 'mss', 4, 64, 1, 60, '2,4,8,1,3', 1, true, 7, false, false, 0, false, false, false, 'SampleOS', 'kernel A'),
      (1, 'any', 0, 128, 1, 52, '2,1,3,1,1,4', 1, true, 8, false, true, 0, false, false, false, 'OtherOS', 'kernel B'),
      (2, 'modulo', 8192, 64, 0, 44, '2', 1460, false, 0, false, true, 0, false, false, true, 'Third', 'any'),
      (3, 'mss', 20, 64, 1, 0, '2,1,1,8,55', 1, true, 0, false, true, 34, true, true, false, 'Last', 'old'))
      t(sig_id, win_mode, win, ttl, df, size, opts, mss, mss_mod, wscale, wscale_mod, zero_stamp, quirks, userland, no_detail, generic, genre, detail)""",
    "read_service_signatures": """select * from (values (0, 'www', 'SampleHTTPD', '$1', '', 'Server: Sample/([0-9.]+)'), (1, 'ssh', 'SampleSSH', '$2', '$1', 'SSH-([.0-9]+)-Sample_(\\S+)'), (2, 'mail', 'Mailer', '', 'misc', '^220 .*, ready'))
      t(sig_id, service, app, version, misc, regex)""",
    "read_vendors": "select * from (values ('02FE00', 24, 'SampleVendor'), ('0A000001', 28, 'Second Vendor'), ('AABBCC', 24, 'Third')) t(prefix, bits, vendor)",
    "read_ids_rules": "select * from (values (1, 'evil', '(?i)ev[i1]l'), (2, 'x|41|y', null), (3, null, 'plain[0-9]')) t(rule_id, content, regex)",
    "read_config": "select * from (values ('os_syn_fingerprint', '0'), ('interface', 'eth0'), ('empty', '')) t(key, value)",
    "map_catalog": """select * from (values (0, 'src_ip_counter', 'src_ip', 'multi', 'balanced'), (1, 'dst_ip_counter', 'dst_ip', 'multi', 'balanced'), (2, 'subnet_bytes', 'subnet', 'multi', 'balanced'),
      (3, 'udp_counter', 'src_ip,dst_ip,src_port,dst_port', 'single', 'balanced'), (4, 'tcp_flow', 'src_ip,dst_ip,src_port,dst_port', 'single', 'balanced'), (5, 'connection', 'a_ip,b_ip,a_port,b_port', 'single', 'balanced'),
      (6, 'asset', 'ip', 'multi', 'balanced'), (7, 'os_asset', 'ip,sig_id', 'multi', 'balanced'), (8, 'service_asset', 'ip,sig_id,port', 'multi', 'balanced'), (9, 'nat_entry', 'src_ip,dst_ip,src_port,dst_port', 'single', 'balanced'),
      (10, 'port_pool', 'name', 'single', 'static'), (11, 'reassembly', 'src_ip,dst_ip,src_port,dst_port', 'single', 'balanced'), (12, 'whitelist', 'src_ip', 'single', 'hashing')) t(id, name, keys, kind, placement)""",
    "stream_progress": of("select count(*) as received, count(*) filter (proto = 6) as processed, count(*) filter (proto <> 6) as dropped from p"),
}
for _name in ("src_ip_counter", "flow_generation", "connection", "stale_counter"):
    SQL[f"stream_{_name}"] = SQL[_name]
