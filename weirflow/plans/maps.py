"""The state tables of the sample applications, by name. Their columns are those of the queries that compute them."""

from __future__ import annotations

from ..functions.keys import FLOW, SYM
from ..operators.state import StateMap, register

MAPS = [
    register(StateMap("src_ip_counter", ("src_ip",), single=False)),
    register(StateMap("dst_ip_counter", ("dst_ip",), single=False)),
    register(StateMap("subnet_bytes", ("subnet",), single=False)),
    register(StateMap("udp_counter", FLOW)),
    register(StateMap("tcp_flow", FLOW)),
    register(StateMap("connection", SYM)),
    register(StateMap("asset", ("ip",), single=False)),
    register(StateMap("os_asset", ("ip", "sig_id"), single=False)),
    register(StateMap("service_asset", ("ip", "sig_id", "port"), single=False)),
    register(StateMap("nat_entry", FLOW)),
    register(StateMap("port_pool", ("name",), placement="static")),
    register(StateMap("reassembly", FLOW)),
    register(StateMap("whitelist", ("src_ip",), placement="hashing")),
]
