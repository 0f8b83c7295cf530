"""The three trace tables. trace names a log within a data set, seq is the line order within a trace and type.

A trace table read from files of others may lack trace and seq; see sources.store.
"""

from __future__ import annotations

KINDS = ("ufs", "block", "cus")

_EVENTS = {
    "ufs": "time double, process string, cpu long, action string, tag long, opcode string, lba long, size long, groupid long, hwqid long",
    "block": "time double, process string, cpu long, flags string, action string, devmajor long, devminor long, io_type string, extra long, sector long, size long, comm string",
    "cus": "opcode string, lba long, size long, start_time double, end_time double",
}
_DERIVED = {
    "ufs": "qd long, dtoc double, ctoc double, ctod double, continuous boolean",
    "block": "qd long, dtoc double, ctoc double, ctod double, continuous boolean",
    "cus": "start_qd long, end_qd long, dtoc double, ctoc double, ctod double, continuous boolean",
}

EVENTS = {k: f"trace string, seq long, {v}" for k, v in _EVENTS.items()}
TABLES = {k: f"{EVENTS[k]}, {_DERIVED[k]}" for k in KINDS}

# Names of actions, opcodes of reads, writes and unmaps, sizes in bytes.
SEND = {"ufs": "send_req", "block": "block_rq_issue"}
COMPLETE = {"ufs": "complete_rsp", "block": "block_rq_complete"}
TIME = {"ufs": "time", "block": "time", "cus": "start_time"}
GROUP = {"ufs": "opcode", "block": "io_type", "cus": "opcode"}
ADDRESS = {"ufs": "lba", "block": "sector", "cus": "lba"}
UNIT_BYTES = {"ufs": 4096, "block": 512, "cus": 512}
READ, WRITE, UNMAP = "0x28", "0x2a", "0x42"
MS = 1000.0

#: Rows of a preview.
PREVIEW_ROWS = 500_000
