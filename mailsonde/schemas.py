"""Declared schemas of the relations that operators pass on; nothing is inferred."""

PACKETS = "capture_id string, index long, ts double, caplen int, wirelen int, vlan_id int, payload binary"
CAPTURES = "capture_id string, sha256 string, format string, link_type int, snaplen long, packets long, malformed long, bytes long, warnings array<string>"
QUALITY = "struct<retrans_count:int,overlap_count:int,gaps:array<struct<offset:long,len:long>>,complete:boolean,buffer_truncated:boolean,direction_inferred:boolean>"
FINDING = "struct<rule_id:string,severity:string,description:string,evidence:string>"
CHUNKS = "array<struct<dir:string,ts:double,data:binary>>"
REASSEMBLED = (
    "client_ip string, client_port int, server_ip string, server_port int, vlan_id int, first_seen double, last_seen double, "
    "c2s_bytes long, s2c_bytes long, c2s_packets long, s2c_packets long, c2s_payload binary, s2c_payload binary, "
    f"chunks {CHUNKS}, quality {QUALITY}, findings array<{FINDING}>"
)
TRANSITIONS = "array<struct<from_state:string,to_state:string,ts:double,stream_offset:long,evidence:string>>"
FSM = (
    "struct<state:string,server_banner:string,ehlo_domain:string,advertised_capabilities:array<string>,auth_mechanisms_used:array<string>,"
    f"credentials_in_cleartext:boolean,upgrade_latency_ms:double,transitions:{TRANSITIONS},findings:array<{FINDING}>>"
)
HELLO = (
    "struct<legacy_version:int,random:binary,cipher_suites:array<int>,compression_methods:array<int>,ext_order:array<int>,supported_versions:array<int>,"
    "supported_groups:array<int>,ec_point_formats:array<int>,signature_algorithms:array<int>,alpn_protocols:array<string>,server_name:string>"
)
SERVER_HELLO = "struct<legacy_version:int,selected_version:int,random:binary,selected_cipher:int,selected_compression:int,ext_order:array<int>,selected_alpn:string,downgrade_sentinel:boolean,hello_retry:boolean,key_share_group:int>"
TLS = f"struct<client_hello:{HELLO},server_hello:{SERVER_HELLO},certificates:array<binary>,alerts:array<struct<level:string,description:string>>,handshake_completed:boolean,certificates_observable:boolean,stapled_ocsp:binary,ticket_lifetime:long,dh_key_bits:int,curve:int>"
FINDINGS = ("rule_id", "severity", "session_id", "title", "evidence")
