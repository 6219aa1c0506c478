"""Reading the text of physical plans."""

from __future__ import annotations


def exchanges_below(plan: str, scan: str) -> bool:
    """True if an Exchange stands between a scan of this table and the join above it."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if scan in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            if "Exchange" in line:
                return True
            if "Join" in line:
                return False
    raise AssertionError("no join above the scan")
